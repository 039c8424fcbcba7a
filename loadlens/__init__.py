"""Load-test, telemetry and answer analytics as lazy Spark DataFrame operators."""
