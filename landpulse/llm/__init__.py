"""Operators for preparing training text: each works on a table of documents and keeps whole results."""
