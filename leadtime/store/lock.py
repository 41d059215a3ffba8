"""One writer at a time, across processes and handles."""

from __future__ import annotations

import fcntl
import os
import threading
import time
from contextlib import contextmanager
from pathlib import Path

from ..errors import StoreLockedError

_held = threading.local()


@contextmanager
def store_lock(root: Path, timeout: float = 30.0, poll: float = 0.05):
    """Hold the store's lock; taking it twice on a thread is a programming error."""
    mine = _held.__dict__.setdefault("roots", set())
    key = str(root)
    if key in mine:
        raise RuntimeError("this thread has the store lock already")
    with open(root / ".lock", "a") as file:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except OSError:
                if time.monotonic() >= end:
                    raise StoreLockedError(f"the store was locked for {timeout} s") from None
                time.sleep(poll)
        mine.add(key)
        try:
            yield
        finally:
            mine.discard(key)
            fcntl.flock(file, fcntl.LOCK_UN)


def write_json(path: Path, text: str) -> None:
    """Replace a file in one step."""
    own = path.with_name(f".{path.name}.{os.getpid()}.{threading.get_ident()}")
    own.write_text(text)
    with open(own) as f:
        os.fsync(f.fileno())
    os.replace(own, path)
