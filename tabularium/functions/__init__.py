"""Column functions, feature primitives and the feature language."""
