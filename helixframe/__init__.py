"""Sequencing-data analytics on PySpark."""
