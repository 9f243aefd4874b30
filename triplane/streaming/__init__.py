"""Statements as streams."""
