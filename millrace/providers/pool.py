"""A pool of servers inside a task: a free one takes the next batch."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any, TypeVar

from .base import Provider, UnavailableError
from .leases import AWAY_SECONDS, Leases

log = logging.getLogger("millrace.pool")
Batch = TypeVar("Batch")


def first_server(partition: Any, servers: int) -> Any:
    """The server that a task asks first, for a number or a column of numbers: tasks are spread over all of them."""
    return partition % servers


class ServerPool:
    """Clients that are lent to batches, so a fast server answers more of them.

    A server that cannot be reached is put aside for a while and its batch goes to
    another; only when none is left does the batch fail under the error policy. With
    ``leases`` the places at servers are those of all tasks of a job; without, each
    server answers one batch of this task at a time.
    """

    def __init__(self, makers: Sequence[Callable[[], Provider]], away: float = AWAY_SECONDS, leases: Leases | None = None):
        self.makers, self.away, self.leases = list(makers), away, leases
        self.clients: list[Provider] = []
        #: Clients of each server that no batch holds: one answers a batch at a time.
        self.idle: dict[int, list[Provider]] = {}
        self.free, self.aside = list(range(len(self.makers))), {}
        self.changed = threading.Condition()

    def lease(self) -> int | None:
        """Number of a free server; none if no server is left."""
        if self.leases is not None:
            return self.leases.take()
        with self.changed:
            while True:
                now = time.monotonic()
                for client in [c for c, since in self.aside.items() if now - since > self.away]:
                    del self.aside[client]
                    self.free.append(client)
                if self.free:
                    return self.free.pop(0)
                if len(self.aside) == len(self.makers):
                    return None
                self.changed.wait(1.0)

    def client(self, number: int) -> Provider:
        """A client of the server, made when none is idle."""
        with self.changed:
            if self.idle.get(number):
                return self.idle[number].pop()
        made = self.makers[number]()
        with self.changed:
            self.clients.append(made)
        return made

    def give_back(self, number: int, client: Provider | None, reached: bool = True) -> None:
        with self.changed:
            if client is not None:
                self.idle.setdefault(number, []).append(client)
        if self.leases is not None:
            return self.leases.give(reached)
        with self.changed:
            if reached:
                self.free.append(number)
            else:
                self.aside[number] = time.monotonic()
            self.changed.notify_all()

    def ask(self, batch: Batch, work: Callable[[Provider, Batch], Any]) -> Any:
        while (number := self.lease()) is not None:
            reached, client = True, None
            try:
                client = self.client(number)
                client.raise_unavailable = True
                return work(client, batch)
            except UnavailableError as e:
                log.warning("a server is put aside: %s", e)
                reached = False
            finally:
                self.give_back(number, client, reached)
        last = self.client(0)
        last.raise_unavailable = False
        return work(last, batch)

    def run(self, batches: Iterator[Batch], work: Callable[[Provider, Batch], Any], in_flight: int) -> Iterator[tuple[Batch, Any]]:
        """(batch, result) in order of completion, with so many batches in flight at most."""
        if in_flight <= 1:
            # One after another needs no thread, nor the time of handing batches to it and back.
            yield from ((batch, self.ask(batch, work)) for batch in batches)
            return
        batches, pending = iter(batches), {}
        with ThreadPoolExecutor(min(len(self.makers), max(1, in_flight))) as threads:
            try:
                while True:
                    while len(pending) < max(1, in_flight) and (batch := next(batches, None)) is not None:
                        pending[threads.submit(self.ask, batch, work)] = batch
                    if not pending:
                        return
                    done: set[Future] = wait(pending, return_when=FIRST_COMPLETED).done
                    for future in done:
                        yield pending.pop(future), future.result()
            finally:
                for future in pending:
                    future.cancel()

    def __enter__(self) -> ServerPool:
        return self

    def __exit__(self, *_: object) -> None:
        if self.leases is not None:
            self.leases.close()
        for client in self.clients:
            client.close()
