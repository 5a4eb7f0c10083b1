"""Operators that prepare text for training language models. Nothing else in heddle imports this package."""
