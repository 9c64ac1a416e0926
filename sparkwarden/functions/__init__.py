"""Column functions: JVM-side expressions only, no Python per row."""
