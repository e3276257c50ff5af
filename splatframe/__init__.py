"""splatframe: splat-cloud and point-cloud analytics as Spark DataFrame operators."""
