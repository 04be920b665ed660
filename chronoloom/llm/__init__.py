"""Operators for preparing text corpora, one module each; nothing else in the library imports this subpackage."""
