"""Operators for training-data pipelines. Nothing else in quarrylens imports this subpackage."""
