"""Column functions: text in, Column out, all JVM-side."""
