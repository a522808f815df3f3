"""Corpora of linked documents as DataFrames."""
