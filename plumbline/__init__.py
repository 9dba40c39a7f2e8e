"""plumbline: a Spark-first retrieval and analytics engine."""
