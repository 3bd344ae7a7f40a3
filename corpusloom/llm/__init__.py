"""Operators for preparing language-model training data.

Nothing else in corpusloom imports this subpackage.
"""
