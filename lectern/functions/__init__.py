"""Text functions: as built-in column expressions (native), and in plain Python where order or Unicode tables matter (exact)."""
