"""Document intelligence on Spark: corpus building, retrieval, triage and statistics."""
