"""Dataset to dataset and dataset to report operations."""
