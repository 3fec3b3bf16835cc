"""Incremental encoding."""
