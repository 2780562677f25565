"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Python functions that run in tasks import this package: ship it to the executors (``--py-files``) or install it there.
"""
