"""Catalog search and analytics as Spark DataFrame operators."""
