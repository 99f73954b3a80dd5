"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage. Each operator has a general
interface of its own; ``queries`` applies the operators to the given tables.
"""
