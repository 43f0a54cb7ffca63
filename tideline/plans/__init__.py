"""Registered queries: each pairs a Spark job with the SQL that states the same result."""
