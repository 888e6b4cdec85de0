"""Operators on DataFrames of documents, terms, vectors, edges and states."""
