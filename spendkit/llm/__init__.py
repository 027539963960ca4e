"""Operators for building training data from web crawls and document collections.

One module per operator; each takes and returns DataFrames. `queries` registers them over the test tables.
Nothing outside this package imports it.
"""
