"""Column expressions: every function takes and returns ``Column`` and stays on the JVM."""
