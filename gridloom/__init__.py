"""gridloom: spatial energy-system analytics as Spark DataFrame jobs."""
