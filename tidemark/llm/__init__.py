"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it; it can be deleted without touching the log-analytics engine.
"""
