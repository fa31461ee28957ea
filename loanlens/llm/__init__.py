"""Operators for preparing training corpora: one module an operator, their
queries in ``catalog``. Nothing outside this package imports it."""
