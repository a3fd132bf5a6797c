"""Operators of a training-data pipeline: one module for each, and `catalog` with their registered queries."""
