"""motilis: clip-level exposure analytics as Spark DataFrame plans."""
