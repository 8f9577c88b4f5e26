"""From Spark failures to the exceptions of array code."""

from __future__ import annotations

from contextlib import contextmanager

ARITHMETIC = "tesserae: arithmetic error"


@contextmanager
def translated():
    """An arithmetic error that a read cell raised on an executor becomes ArithmeticError."""
    try:
        yield
    except Exception as e:
        if ARITHMETIC in str(e):
            raise ArithmeticError("integer division by zero or negative exponent") from e
        raise
