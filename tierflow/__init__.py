"""Prompt tiering and routing analytics as Spark DataFrame operators."""
