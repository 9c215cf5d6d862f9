"""Operators for building training corpora from documents. Nothing outside this subpackage imports it."""
