"""Operators of large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator has its own module;
``registry`` holds the queries that apply them to whole tables.
"""
