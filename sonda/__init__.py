"""Hybrid document search and corpus preparation on Spark."""
