"""Relational, graph and sequence operators."""
