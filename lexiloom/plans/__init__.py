"""Whole plans made of operators, and the registered queries with their SQL."""
