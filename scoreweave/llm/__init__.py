"""Operators for training corpora: one module per operator, and the queries registered for them."""
