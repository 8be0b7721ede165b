"""Operators for preparing language-model training data, and their queries."""
