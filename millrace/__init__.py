"""Millrace: corpus curation and experiment analytics as Spark DataFrame plans."""
