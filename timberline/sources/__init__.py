"""Readers and writers of feature matrices and models."""
