"""Operators for preparing language-model training data with Spark.

Nothing else in ``wavemill`` imports this subpackage.
"""
