"""Operators on text corpora, and their registered queries."""
