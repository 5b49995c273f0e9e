"""Operators for training data: runs, percentiles, splits, leaks, mixtures and harmful text."""
