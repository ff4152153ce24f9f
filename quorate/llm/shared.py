"""Models that a Python worker builds once from a broadcast value."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import SparkContext

#: What this worker holds: one model of each kind, with the token of the value it was built from.
_HELD: dict[str, tuple[str, Any]] = {}


class Shared:
    """A broadcast value under a token of its own, so that a reused worker never serves another corpus's model."""

    def __init__(self, sc: SparkContext, value: Any, token: str | None = None):
        self.token = token or uuid.uuid4().hex
        self.held = sc.broadcast(value)

    @property
    def value(self) -> Any:
        return self.held.value

    def model(self, kind: str, build: Callable[[Any], Any]) -> Any:
        found = _HELD.get(kind)
        if found is None or found[0] != self.token:
            found = _HELD[kind] = (self.token, build(self.held.value))
        return found[1]
