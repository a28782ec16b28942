"""Places at servers, leased to the tasks of a job by its driver.

Python workers reach no file system but through Spark, so places are not files: the
driver serves them over TCP. A task holds a connection for each batch in flight;
when it dies its connections close and its places are free again, without waiting for
them to expire. A server that could not be reached is put aside for all tasks.
"""

from __future__ import annotations

import asyncio
import json
import secrets
import socket
import threading
import time
from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Seconds after which a server that could not be reached is tried again.
AWAY_SECONDS = 30.0
#: Bytes of a line to the broker, at most.
LONGEST_LINE = 1 << 16


@dataclass(frozen=True)
class LeaseAddress:
    """Where tasks ask for places; shipped to workers."""

    host: str
    port: int
    secret: str


class LeaseBroker:
    """So many places at each of some servers. Use it as a context; ``address`` is for tasks.

    Those that wait are served in order of their asking, and a place that is given back goes
    to the first of them at once.
    """

    def __init__(self, servers: int, places: int, host: str = "127.0.0.1", away: float = AWAY_SECONDS):
        self.servers, self.places, self.away = servers, places, away
        self.busy: Counter[int] = Counter()
        self.aside: dict[int, float] = {}
        #: Seconds that a server takes for a batch, of late.
        self.pace: dict[int, float] = {}
        self.talks: set[_Talk] = set()
        self.waiting: deque[_Talk] = deque()
        self.host, self.secret, self.port = host, secrets.token_hex(16), 0
        self._ready, self._loop = threading.Event(), asyncio.new_event_loop()
        self._trouble: BaseException | None = None
        self._thread = threading.Thread(target=self._serve, daemon=True)

    @property
    def address(self) -> LeaseAddress:
        return LeaseAddress(self.host, self.port, self.secret)

    def __enter__(self) -> LeaseBroker:
        self._thread.start()
        self._ready.wait()
        if self._trouble:
            raise self._trouble
        return self

    def __exit__(self, *_: object) -> None:
        self._loop.call_soon_threadsafe(self._loop.stop)
        self._thread.join(10)

    def _serve(self) -> None:
        asyncio.set_event_loop(self._loop)
        try:
            server = self._loop.run_until_complete(self._loop.create_server(lambda: _Talk(self), self.host, 0))
            self.port = server.sockets[0].getsockname()[1]
        except BaseException as e:  # noqa: BLE001
            self._trouble = e
            return
        finally:
            self._ready.set()
        self._loop.run_forever()
        server.close()
        self.waiting.clear()
        for talk in self.talks:
            talk.link.abort()
        self._loop.run_until_complete(asyncio.sleep(0))
        self._loop.close()

    def _pick(self, first: int) -> int | None:
        """The least busy server with a free place; among equals the quickest, and before any is known the task's own."""
        now = time.monotonic()
        self.aside = {k: since for k, since in self.aside.items() if now - since <= self.away}
        free = [k for k in range(self.servers) if k not in self.aside and self.busy[k] < self.places]
        return min(free, key=lambda k: (self.busy[k], self.pace.get(k, 0.0), (k - first) % self.servers), default=None)

    def take(self, talk: _Talk) -> None:
        self.waiting.append(talk)
        self.grant()

    def give(self, place: int, seconds: float | None, reached: bool = True) -> None:
        """``seconds`` is what a batch took, none if it did not end."""
        self.busy[place] -= 1
        if reached and seconds is not None:
            self.pace[place] = (3 * self.pace.get(place, seconds) + seconds) / 4
        if not reached:
            self.aside[place] = time.monotonic()
            self._loop.call_later(self.away + 0.01, self.grant)
        self.grant()

    def grant(self) -> None:
        """Places for those that wait, as far as there are any; no place where no server can be reached."""
        while self.waiting:
            place = self._pick(self.waiting[0].first)
            if place is None and len(self.aside) < self.servers:
                return
            if place is not None:
                self.busy[place] += 1
            self.waiting.popleft().lent(place)


class _Talk(asyncio.Protocol):
    """The broker's end of a connection: a task's lines come in, numbers of servers go out."""

    def __init__(self, broker: LeaseBroker):
        self.broker, self.known, self.rest, self.first = broker, False, b"", 0
        self.held: int | None = None
        self.since = 0.0

    def connection_made(self, link: asyncio.Transport) -> None:
        self.link = link
        self.broker.talks.add(self)

    def data_received(self, data: bytes) -> None:
        *lines, self.rest = (self.rest + data).split(b"\n")
        try:
            for line in lines:
                if not self.link.is_closing():
                    self._hear(json.loads(line))
            if len(self.rest) > LONGEST_LINE:
                raise ValueError("a line is too long")
        except (ValueError, KeyError, TypeError, AttributeError):
            self.link.abort()

    def _hear(self, said: dict) -> None:
        if not self.known:
            self.known = secrets.compare_digest(str(said.get("secret")).encode(), self.broker.secret.encode())
            if not self.known:
                self.link.close()
        elif said["ask"] == "take":
            if self.held is not None or self in self.broker.waiting:
                raise ValueError("a connection has one place at a time")
            self.first = int(said["first"])
            self.broker.take(self)
        elif said["ask"] == "give" and self.held is not None:
            place, self.held = self.held, None
            self.broker.give(place, time.monotonic() - self.since, bool(said["reached"]))

    def lent(self, place: int | None) -> None:
        self.held, self.since = place, time.monotonic()
        self.link.write(f"{json.dumps(place)}\n".encode())

    def connection_lost(self, trouble: Exception | None) -> None:
        """A task that dies while it waits takes no place; what a dead one held is free again."""
        self.broker.talks.discard(self)
        if self in self.broker.waiting:
            self.broker.waiting.remove(self)
        if self.held is not None:
            place, self.held = self.held, None
            self.broker.give(place, None)


class Leases:
    """A task's side: one connection for each thread."""

    def __init__(self, address: LeaseAddress, first: int = 0, connect: Callable = socket.create_connection):
        self.address, self.first, self.connect = address, first, connect
        self.own, self.all, self.lock = threading.local(), [], threading.Lock()

    def _file(self):
        if not hasattr(self.own, "file"):
            link = self.connect((self.address.host, self.address.port))
            # A task says one short line after another; held back until the last one is acknowledged, each would cost 40 ms.
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            self.own.file = link.makefile("rwb")
            with self.lock:
                self.all.append((link, self.own.file))
            self._say({"secret": self.address.secret})
        return self.own.file

    def _say(self, what: dict) -> None:
        self.own.file.write(f"{json.dumps(what)}\n".encode())
        self.own.file.flush()

    def take(self) -> int | None:
        """Number of a server at which a place is free now; none if no server can be reached."""
        file = self._file()
        self._say({"ask": "take", "first": self.first})
        line = file.readline()
        if not line:
            raise ConnectionError("the driver gives no more places")
        return json.loads(line)

    def give(self, reached: bool = True) -> None:
        """Give the thread's place back."""
        self._file()
        self._say({"ask": "give", "reached": reached})

    def close(self) -> None:
        with self.lock:
            for link, file in self.all:
                for end in (file, link):
                    try:
                        end.close()
                    except OSError:
                        pass
            self.all.clear()


def driver_host(spark: SparkSession) -> str:
    """The name under which executors reach the driver."""
    return spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
