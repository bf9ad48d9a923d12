"""Operators of a large-scale training-data pipeline. Nothing else in quillspark imports this subpackage."""
