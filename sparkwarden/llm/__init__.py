"""Operators for preparing language-model training data.

Nothing outside this folder imports it; ``queries`` registers one query per operator.
"""
