"""Values that a worker keeps between rows, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable

#: Bytes of keys and values in one of the two halves of a table, and the longest key that is kept.
KEPT_BYTES = 48 * 1024 * 1024
LONGEST_KEY = 256
#: What an entry takes beside its key and value.
ENTRY_BYTES = 150


class Kept(dict):
    """Values made on first use; ``table[key]`` is a plain look-up for a key that is there.

    When the table is full it becomes the old half and a new one begins; keys that are asked for again move
    over, so frequent keys stay and rare ones go. Long keys are answered and not kept.
    """

    def __init__(self, make: Callable[[object], object], limit: int = KEPT_BYTES, longest: int = LONGEST_KEY) -> None:
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest
        self.old: dict = {}
        self.size = 0

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self[key] = value
        self.size += len(key) + len(value) + ENTRY_BYTES
        return value

    def trim(self) -> None:
        """Between two rows: begin a new half where this one is full."""
        if self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
