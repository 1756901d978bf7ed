"""Scalar functions as SQL expressions.

Every function takes SQL expressions and returns one, ready for ``selectExpr``, ``F.expr`` or a filter.
A whole expression then reaches Catalyst in one step, whatever its size, and stays built-in all the way.
"""
