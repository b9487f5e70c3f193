"""Column-level helpers: exact integer arithmetic, time, decision tables."""
