"""Spark-first kinase-activity analytics."""
