"""Column functions; built from Spark's own wherever they can be, so that they stay inside code generation."""
