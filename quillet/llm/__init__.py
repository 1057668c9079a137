"""Operators for training-data pipelines; nothing else in quillet imports this subpackage."""
