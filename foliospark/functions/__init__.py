"""Scalar functions: text, cleaners, tokens, keys."""
