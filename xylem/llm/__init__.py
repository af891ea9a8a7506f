"""Operators for training-data pipelines: whole-corpus text, vector and chat jobs.

Nothing else in the package imports this subpackage.
"""
