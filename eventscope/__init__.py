"""Exploring and classifying events in space and time, as Spark DataFrame operators."""
