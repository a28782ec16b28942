"""Corpus operators for training-data pipelines.

Nothing else in the package imports this subpackage; ``registry`` lists its
queries and their SQL for the entry module.
"""
