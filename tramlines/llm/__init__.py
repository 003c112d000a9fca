"""Operators for preparing training text at scale.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames, keeps
extra input columns out of its way by selecting the columns it needs first, treats a null text
as an empty one, and gives the same rows for any partitioning of its input.
"""
