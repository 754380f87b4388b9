"""Video-observation analytics as Spark DataFrame operators."""
