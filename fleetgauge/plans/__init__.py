"""Composed analyses: the health rules and the end-to-end job analysis."""
