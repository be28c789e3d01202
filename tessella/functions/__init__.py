"""Column functions: signal levels, scores and labels, all on the JVM side."""
