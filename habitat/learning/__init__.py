"""Classifiers, search and attribution on Spark."""
