"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; it only builds on Spark, NumPy, Arrow and the tokenizer files whose
paths are passed in.
"""
