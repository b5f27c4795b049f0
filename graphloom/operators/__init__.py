"""Relational operators over the graph and the state tables."""
