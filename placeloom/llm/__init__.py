"""Operators of a large-scale training-data pipeline.

Self-contained: nothing else in the package imports this folder, and it imports nothing from the rest of the package.
"""
