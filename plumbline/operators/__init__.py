"""Operators over tables and columns."""
