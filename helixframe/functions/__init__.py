"""Column expressions: each takes and returns Spark columns, and runs in the JVM."""
