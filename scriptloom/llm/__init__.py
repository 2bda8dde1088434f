"""Operators for preparing training text: stand-alone Spark jobs.

Nothing outside this subpackage imports it.  Every module holds one operator
with its own interface; ``queries`` binds them to the tables of a data folder.
"""
