"""Corpus analytics as Spark DataFrame plans."""
