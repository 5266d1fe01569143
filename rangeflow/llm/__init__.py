"""Operators for large training-data pipelines.

Each module holds one operator with a general interface, and a thin ``query``
that derives the registered ``opN_<name>`` result from it.  Nothing outside
this subpackage imports it.
"""
