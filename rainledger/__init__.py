"""Seasonal panel analytics as Spark DataFrame operators."""
