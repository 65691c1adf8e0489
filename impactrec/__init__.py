"""Product impact analytics on Spark."""
