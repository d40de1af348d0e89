"""Operators for preparing language-model training data; nothing outside this subpackage imports it."""
