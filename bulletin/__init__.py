"""bulletin: Spark-first analytics over semi-structured, multi-source notices."""
