"""Spark-first engine for classifying, segmenting, linking and reconciling page text."""
