"""Relational operators of tree ensembles."""
