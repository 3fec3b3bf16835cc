"""Operators over histories: resolution, intervals, segments, orderings, diagnostics."""
