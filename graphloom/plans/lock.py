"""One writer at a time: a lock file whose holder can be read, for stores on a mounted file system."""

from __future__ import annotations

import fcntl
import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager, suppress


class Busy(RuntimeError):
    """Another process writes; ``holder`` is what it left about itself."""

    def __init__(self, holder: dict | None):
        self.holder = holder or {}
        super().__init__(f"the store is being written by {self.holder.get('agent', 'another process')} (process {self.holder.get('pid', '?')}, since {self.holder.get('since', '?')})")


def agent() -> str:
    return os.environ.get("GRAPHLOOM_AGENT") or "cli"


def holder(store: str) -> dict | None:
    try:
        with open(os.path.join(store, "lock.json"), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


@contextmanager
def write_lock(store: str, wait: float = 0.0) -> Iterator[None]:
    """Holds the lock; waits up to ``wait`` seconds for it, then raises Busy.  The system frees it if the process dies."""
    os.makedirs(store, exist_ok=True)
    note, until = os.path.join(store, "lock.json"), time.monotonic() + wait
    with open(os.path.join(store, "lock"), "ab") as f:
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError as e:
                if time.monotonic() >= until:
                    raise Busy(holder(store)) from e
                time.sleep(0.1)
        try:
            with suppress(OSError), open(note, "w", encoding="utf-8") as told:
                json.dump({"pid": os.getpid(), "agent": agent(), "since": time.strftime("%Y-%m-%d %H:%M:%S")}, told)
            yield
        finally:
            with suppress(OSError):
                os.unlink(note)
            fcntl.flock(f, fcntl.LOCK_UN)
