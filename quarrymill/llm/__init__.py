"""Operators for preparing large text and vector collections.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; ``queries`` binds them to the tables of a data folder.
"""
