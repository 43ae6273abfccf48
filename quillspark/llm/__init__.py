"""Operators for training data: markup, look-alike text, vectors, ranking, packing, mixing."""
