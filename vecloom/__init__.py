"""Vector compression and distributed mean estimation as Spark DataFrame operators."""
