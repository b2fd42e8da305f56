"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; the driver contract file adds its
queries only when the subpackage is present.
"""
