"""graphloom: Spark-first document ingestion, hybrid retrieval and knowledge-graph operators."""
