"""Commerce analytics as lazy PySpark DataFrame plans."""
