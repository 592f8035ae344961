"""bidgraph: procurement-risk analytics and corpus preparation as PySpark DataFrame jobs."""
