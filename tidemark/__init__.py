"""Retail campaign and inventory analytics as Spark DataFrame operators."""
