"""Readers that turn inputs into rows of the document model."""
