"""Revenue-operations analytics as pure PySpark DataFrame jobs."""
