"""Model registry, metrics and cross-validation."""
