"""Operators for preparing large-scale training text.

Nothing else in the library imports this subpackage.
"""
