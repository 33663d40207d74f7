"""lexspan: annotation and analysis of document collections as Spark jobs."""
