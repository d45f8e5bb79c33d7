"""Exploratory analytics as Spark DataFrame operators."""
