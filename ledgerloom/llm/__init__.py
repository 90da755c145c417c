"""Operators that turn raw text, pages and conversations into training data.

Nothing outside this package imports it.
"""
