"""Retrieval, ranking evaluation and corpus preparation as Spark DataFrame jobs."""
