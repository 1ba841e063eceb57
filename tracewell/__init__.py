"""Session analytics as Spark DataFrame operators."""
