"""Operators on collections of documents. Nothing outside this subpackage imports it."""
