"""A Spark-first engine that turns web pages and raw documents into a searchable corpus."""
