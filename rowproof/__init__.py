"""Record reconciliation and corpus preparation as PySpark DataFrame jobs."""
