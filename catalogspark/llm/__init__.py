"""Operators of a training-data pipeline over documents and pages. Nothing else in the package imports this one."""
