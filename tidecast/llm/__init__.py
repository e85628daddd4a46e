"""Operators for preparing language-model training data on Spark.

Thirteen operators, one module each, a registry of their queries (``queries``) and
the DuckDB twins where SQL can express them. Nothing else in the library
imports this subpackage.
"""
