"""Relational operators and storage-layout analytics."""
