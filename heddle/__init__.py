"""heddle: document knowledge, evidence and corpus preparation on Spark."""
