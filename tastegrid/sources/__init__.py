"""Sources and sinks: table readers, reference-shaped views of the driver tables, logs, artifacts."""
