"""Operators that prepare text corpora for language-model training.

Nothing else in the library imports this subpackage. Every operator is a free
function from DataFrames to a DataFrame; ``queries`` binds each of them to the
test tables.
"""
