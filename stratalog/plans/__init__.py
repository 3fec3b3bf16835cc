"""Whole plans: the tables of one history, and the registered queries with their SQL."""
