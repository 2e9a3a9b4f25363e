"""Operators for large text corpora: what a training-data pipeline needs beside sensor analytics.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
