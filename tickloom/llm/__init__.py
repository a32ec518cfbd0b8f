"""Operators for training-data pipelines: each is DataFrame -> DataFrame; queries are in ``queries.py``."""
