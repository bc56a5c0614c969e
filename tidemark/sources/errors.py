"""What can go wrong in the store; parsers of answers give an ``error`` column instead of failing a job."""

from __future__ import annotations


class MemoryEngineError(Exception):
    """Any error of this engine."""


class DuplicateKeyError(MemoryEngineError, ValueError):
    """An insert met keys that are there already."""


class MissingReferenceError(MemoryEngineError, ValueError):
    """An insert names rows that do not exist."""


class ConcurrentWriteError(MemoryEngineError):
    """Another writer committed first; nothing of this write is visible."""


class UnknownTableError(MemoryEngineError, KeyError):
    """A table that was never made."""
