"""Registered plans over the test tables: each is an operator on counts made from them."""
