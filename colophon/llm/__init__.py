"""Operators for large training-data pipelines, each usable on its own.

Nothing outside this subpackage imports it.
"""
