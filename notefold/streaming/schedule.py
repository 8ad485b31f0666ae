"""Runs and refreshes that never overlap, on the driver."""

from __future__ import annotations

import threading
from collections.abc import Callable


class Runner:
    """Runs work once at a time: a request while it runs is refused."""

    def __init__(self, work: Callable[[], None]):
        self._work, self._busy = work, threading.Lock()

    def request(self) -> bool:
        """Run the work now, in this thread, unless it is running; whether it ran."""
        if not self._busy.acquire(blocking=False):
            return False
        try:
            self._work()
        finally:
            self._busy.release()
        return True

    def every(self, seconds: float, stop: threading.Event) -> None:
        """Request a run again and again until stop is set; the pause starts when a run has ended, and a tick while another runs is skipped."""
        while not stop.wait(seconds):
            self.request()


class Refresher:
    """Runs work once at a time: requests while it runs become one more run after it."""

    def __init__(self, work: Callable[[], None]):
        self._work, self._guard, self._running, self._again = work, threading.Lock(), False, False

    def request(self) -> None:
        with self._guard:
            if self._running:
                self._again = True
                return
            self._running = True
        while True:
            try:
                self._work()
            except BaseException:
                with self._guard:
                    self._running = self._again = False
                raise
            with self._guard:
                if not self._again:
                    self._running = False
                    return
                self._again = False
