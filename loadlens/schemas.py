"""Column layouts of the tables, stated once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import types as T

# Column names of the load tool's sample file.
SAMPLE_COLUMNS = [
    "timeStamp", "elapsed", "label", "responseCode", "responseMessage", "threadName",
    "dataType", "success", "failureMessage", "bytes", "sentBytes", "grpThreads",
    "allThreads", "URL", "Latency", "Hostname", "IdleTime", "Connect",
]

# Label of the sampler whose rows count.
HTTP_SAMPLER = "HTTP Request"

# Emission metrics as (column, title, unit).
EMISSION_METRICS = [
    ("emissions", "Emissions", ""),
    ("emissions_rate", "Emissions Rate", ""),
    ("cpu_power", "CPU Power", "W"),
    ("gpu_power", "GPU Power", "W"),
    ("ram_power", "RAM Power", "W"),
    ("cpu_energy", "CPU Energy", "Wh"),
    ("gpu_energy", "GPU Energy", "Wh"),
    ("ram_energy", "RAM Energy", "Wh"),
    ("energy_consumed", "Total Energy", "Wh"),
]

# Host metrics of the overview chart as (column, title, unit).
HOST_METRICS = [
    ("cpu_cores_sum", "CPU Sum", "%"),
    ("memory_percent", "Memory", "%"),
    ("gpu_0_util_percent", "GPU Util", "%"),
    ("gpu_0_mem_used_mb", "GPU Mem", "MB"),
]

# Metrics charted against users after correlation with the host.
CORRELATED_HOST_METRICS = [
    "cpu_usage", "memory_percent", "gpu_util", "gpu_mem", "avg_error_rate", "avg_elapsed",
]

# Leading columns of the answer-evaluation result file.
SPAN_COLUMNS = [
    "name", "span_kind", "parent_id", "start_time", "end_time",
    "status_code", "status_message", "events", "context.span_id",
    "context.trace_id", "attributes.output.value", "attributes.llm",
    "attributes.generation_time_sec", "attributes.input.value",
]
SPAN_INPUT = "attributes.input.value"
SPAN_OUTPUT = "attributes.output.value"
SPAN_SECONDS = "attributes.generation_time_sec"

# Correctness labels.
CORRECT = "true"
WRONG = "false"
DUPLICATE = "DUPLICATE"
NO_TRUTH = "NO_GROUND_TRUTH"

USER_BINS = {
    "user_bin": T.LongType(),
    "bin_start_timestamp": T.TimestampType(),
    "avg_error_rate": T.DoubleType(),
    "avg_elapsed": T.DoubleType(),
    "request_count": T.LongType(),
}

QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
])

CHAT = T.StructType([
    T.StructField("conversations", T.ArrayType(T.StructType([
        T.StructField("from", T.StringType()),
        T.StructField("value", T.StringType()),
    ]))),
])


# Numeric columns of host metrics; core and GPU counts vary by host.
_HOST_NUMBER = re.compile(
    r"(cpu|gpu|ram|memory)_(.+_)?(percent|percent_total|mb|w)|emissions_kg|duration_sec")


# Columns without which a host report stops.
HOST_REQUIRED = ["timestamp", "memory_percent", "gpu_0_util_percent", "gpu_0_mem_used_mb"]


def host_column_type(name: str) -> T.DataType:
    """Type of a host-metrics column, told from its name."""
    if name == "timestamp":
        return T.LongType()
    return T.DoubleType() if _HOST_NUMBER.fullmatch(name) else T.StringType()


def layout(names: list[str], types: Callable[[str], T.DataType]) -> T.StructType:
    """Schema of a file whose header holds ``names``."""
    return T.StructType([T.StructField(n, types(n)) for n in names])


def quoted(name: str) -> str:
    """A column name that may hold dots, safe to hand to ``F.col``."""
    return f"`{name}`"
