"""A bounded cache for Python workers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


#: Longer keys (unbroken segments of encoded data, lines without spaces) are rare and large: they aren't kept.
LONGEST = 64


class Memo(dict):
    """``memo[key]`` computes a missing value once; at most 2 * ``limit`` entries are kept, and no key longer than ``LONGEST``.

    When the young generation is full it becomes the old one, so keys in use stay and others leave.
    """

    def __init__(self, compute: Callable[[Any], Any], limit: int):
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key: Any) -> Any:
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
