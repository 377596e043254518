"""Payment-routing analytics as lazy Spark DataFrame transformations."""
