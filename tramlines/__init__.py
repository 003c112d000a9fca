"""Transit line-graph analytics expressed as Spark DataFrame jobs."""
