"""Corpus operators for preparing training data.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and column names, reads only the columns it names (extra columns, also ones
whose names clash with its own outputs, are ignored), and gives a defined
result for null and empty texts, repeated rows and empty tables.
"""
