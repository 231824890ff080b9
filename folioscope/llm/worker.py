"""Values that every Python worker makes once and keeps from task to task."""
from __future__ import annotations

from collections.abc import Callable


class PerWorker:
    """To be broadcast: a worker keeps its broadcast values, and with them what `get` has made there."""

    def __init__(self, make: Callable, *args):
        self.make, self.args, self.made = make, args, None

    def __getstate__(self):
        return {"make": self.make, "args": self.args, "made": None}

    def get(self):
        if self.made is None:
            self.made = self.make(*self.args)
        return self.made
