"""Readers and writers of ontologies, clauses and answers."""
