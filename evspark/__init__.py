"""evspark: evidence-based retrieval, checking and corpus work as Spark DataFrame jobs."""
