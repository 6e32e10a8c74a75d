"""Operators for large training-corpus pipelines. Nothing else in the package imports this folder."""
