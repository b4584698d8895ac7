"""Searches from a typing user: only the newest request runs next, and stale answers are told apart."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Request:
    stamp: int
    query: str
    mode: str
    limit: int


@dataclass(frozen=True)
class Answer:
    """``hits`` of a request, or its ``error``."""

    stamp: int
    hits: tuple = ()
    error: str | None = None


class Worker:
    """A mailbox for one request: a newer one takes the place of one that waits; one that runs ends.

    ``view`` keeps what to show: an answer to an older request than the last submitted is dropped, a failed query
    keeps the hits before it, and a blank one clears them.
    """

    def __init__(self, search: Callable[[str, str, int], list]) -> None:
        self._search = search
        self._wake = threading.Condition()
        self._next: Request | None = None
        self._busy = self._stop = False
        self.submitted = 0
        self.view = Answer(0)
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def submit(self, query: str, mode: str, limit: int) -> int:
        with self._wake:
            self.submitted += 1
            if query.strip():
                self._next = Request(self.submitted, query, mode, limit)
            else:
                self._next, self.view = None, Answer(self.submitted)
            self._wake.notify_all()
            return self.submitted

    def _accept(self, answer: Answer) -> None:
        if answer.stamp == self.submitted:
            self.view = answer if answer.error is None else Answer(answer.stamp, self.view.hits, answer.error)

    def _run(self) -> None:
        while True:
            with self._wake:
                self._busy = False
                self._wake.notify_all()
                self._wake.wait_for(lambda: self._next is not None or self._stop)
                if self._stop:
                    return
                request, self._next, self._busy = self._next, None, True
            try:
                answer = Answer(request.stamp, tuple(self._search(request.query, request.mode, request.limit)))
            except Exception as e:  # noqa: BLE001 - shown to the user
                answer = Answer(request.stamp, error=str(e))
            with self._wake:
                self._accept(answer)

    def settled(self, timeout: float | None = None) -> bool:
        """Wait until nothing waits or runs."""
        with self._wake:
            return self._wake.wait_for(lambda: self._next is None and not self._busy, timeout)

    def close(self) -> None:
        with self._wake:
            self._stop = True
            self._wake.notify_all()
        self._thread.join()
