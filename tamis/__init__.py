"""tamis: a Spark-first engine for corpus curation and analytics."""
