"""Document-evidence analytics on Spark: corpus building, ranked retrieval, facts, briefs and incremental ingestion."""
