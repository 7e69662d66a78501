"""Query plans: named jobs over the driver tables and their SQL equivalents."""
