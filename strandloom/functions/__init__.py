"""Column functions and small helpers, all evaluated in the JVM."""
