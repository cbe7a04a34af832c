"""Versioned updates and sessions."""
