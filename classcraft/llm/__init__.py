"""Operators for preparing training data: each module is one operator, `queries` registers them."""
