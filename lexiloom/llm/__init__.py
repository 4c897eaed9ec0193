"""Operators that prepare training data for language models.

Nothing else in the library imports this subpackage. ``queries`` registers one query for each
operator; the operators keep general interfaces of their own.
"""
