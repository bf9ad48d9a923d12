"""Relational operators over the document model."""
