"""Field-trust analytics for extracted documents, as PySpark DataFrame jobs."""
