"""Semantic navigation over code and text, on Spark."""
