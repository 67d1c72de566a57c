"""Whole workflows made of the operators."""
