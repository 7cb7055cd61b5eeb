"""Whole runs: profile, synthesis, search, model comparison."""
