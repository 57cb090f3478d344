"""Whole analyses, made of operators."""
