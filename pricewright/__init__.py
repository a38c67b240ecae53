"""Catalogue, panel and pricing analytics as PySpark DataFrame operators."""
