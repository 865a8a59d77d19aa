"""Evaluation analytics over text corpora on Spark."""
