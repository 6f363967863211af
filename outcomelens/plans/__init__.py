"""Operators put together: the hospital pipeline, and its input built from the test tables."""
