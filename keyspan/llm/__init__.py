"""Operators for preparing large text corpora. Nothing else in keyspan imports this subpackage."""
