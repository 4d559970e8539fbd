"""Document, standards and operations analytics as Spark DataFrame jobs."""
