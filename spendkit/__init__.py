"""Spend analytics over card and bank transactions, for every client at once, on Spark."""

__version__ = "0.1.0"
