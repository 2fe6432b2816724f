"""Operators for building language-model training data, on Spark DataFrames.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` derives the registered result
columns from it.
"""
