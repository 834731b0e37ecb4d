"""Spark DataFrame operators for program facts and test-campaign records."""
