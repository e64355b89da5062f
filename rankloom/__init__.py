"""Retrieval, ranking and evidence selection over document tables, as Spark jobs."""
