"""Document analytics and audit operators on Spark."""
