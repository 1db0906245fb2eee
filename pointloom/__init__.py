"""pointloom: point-cloud analytics as Spark DataFrame operators."""
