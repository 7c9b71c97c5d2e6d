"""Column-expression helpers; all of them stay inside Spark's own expression engine."""
