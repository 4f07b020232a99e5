"""Observation analytics on Spark: authorized retrieval, temporal planning, operational analytics."""
