"""Scalar functions over DataFrame columns."""

from .text import casefold, clean_href, nfc, py_repr

__all__ = ["casefold", "clean_href", "nfc", "py_repr"]
