"""Ontoloom: ontology reasoning and corpus analytics as Spark jobs."""
