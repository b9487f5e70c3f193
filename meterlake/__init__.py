"""Usage-and-quota analytics as Spark DataFrame transformations."""
