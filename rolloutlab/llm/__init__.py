"""Operators for large-scale training-data pipelines.

Self-contained: nothing outside this package imports it, and deleting it
leaves the rest of the library working.
"""
