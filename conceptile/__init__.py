"""Concept-vector analytics over document collections, as Spark plans."""
