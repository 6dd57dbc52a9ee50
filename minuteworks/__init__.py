"""minuteworks: a Spark-first engine for agenda-structured document collections."""
