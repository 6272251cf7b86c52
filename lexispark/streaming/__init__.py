"""Entry-at-a-time reading and writing in bounded memory, without a cluster."""

from .entries import LiftReader, LiftWriter, open_reader, open_writer

__all__ = ["open_reader", "LiftReader", "open_writer", "LiftWriter"]
