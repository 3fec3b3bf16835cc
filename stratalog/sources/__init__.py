"""Inputs: histories derived from event, document, conversation and basket tables, and text and CSV files."""
