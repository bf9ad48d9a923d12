"""Column functions of the compliance model."""
