"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; the folder can be removed
and the rest keeps working.
"""
