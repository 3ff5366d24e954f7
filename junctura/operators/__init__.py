"""Operators on counts in long form: a row per feature and cell, absent rows are zero."""
