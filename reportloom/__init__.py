"""Quarterly-report analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames and is lazy, except the
few iterative ones that say so in their docstring.
"""
