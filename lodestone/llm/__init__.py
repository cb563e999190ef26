"""Operators for preparing language-model training data.

Nothing outside this package (and the pipeline module at the top of the
repository) imports it.
"""
