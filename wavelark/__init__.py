"""Wi-Fi observation analytics as PySpark DataFrame jobs."""
