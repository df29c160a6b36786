"""Relational operators: skew handling, overlap, graph, features, vectors, search."""
