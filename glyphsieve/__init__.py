"""Spark-native text integrity engine: scorers, detectors, lexicon training and evaluation as Catalyst plans."""
