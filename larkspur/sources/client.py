"""Access to a public filing archive: paced, retried, one connection. Runs on the driver, since the archive
limits requests a second for each user, however many executors there are."""

from __future__ import annotations

import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from larkspur.operators.filters import check_user_agent


class Pace:
    """Lets at most ``rate`` callers a second through, one after the other: whoever holds the turn waits out what is left
    of the gap since the last start, and then passes the turn on."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        if rate <= 0:
            raise ValueError("the rate is above 0")
        self.gap, self.clock, self.sleep = 1 / rate, clock, sleep
        self.turn, self.started = threading.Lock(), float("-inf")

    def wait(self) -> None:
        with self.turn:
            left = self.started + self.gap - self.clock()
            if left > 0:
                self.sleep(left)
            self.started = max(self.clock(), self.started + self.gap) if self.started > float("-inf") else self.clock()


class ArchiveClient:
    """``get(url)``: 429, 5xx and connection errors are tried again after 5 to 60 s, doubling; 403 is final."""

    def __init__(self, user_agent: str, rate: float = 8.0, tries: int = 5, fetch: Callable[[str, str], tuple[int, bytes]] | None = None, sleep: Callable[[float], None] = time.sleep):
        check_user_agent(user_agent)
        self.agent, self.tries, self.sleep = user_agent, tries, sleep
        self.pace, self.fetch = Pace(rate, sleep=sleep), fetch or self._http

    @staticmethod
    def _http(url: str, agent: str) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=30) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, b""

    def get(self, url: str) -> bytes:
        wait, last = 5.0, ""
        for n in range(self.tries):
            self.pace.wait()
            try:
                status, body = self.fetch(url, self.agent)
            except OSError as e:
                status, body = 599, str(e).encode()
            if status == 403:
                raise PermissionError(f"{url}: refused; the archive asks for a user agent with a contact address")
            if status < 400:
                return body
            if status != 429 and status < 500:
                raise FileNotFoundError(f"{url}: status {status}")
            last = f"status {status}"
            if n + 1 < self.tries:
                self.sleep(wait)
                wait = min(60.0, 2 * wait)
        raise ConnectionError(f"{url}: {last} after {self.tries} tries")
