"""Column expressions shared by the operators (all JVM-side built-ins)."""

from tastegrid.functions.exprs import *  # noqa: F401,F403
