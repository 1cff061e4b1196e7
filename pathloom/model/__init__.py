"""Type models: what a name means on a type."""
