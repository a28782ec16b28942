"""Places pass from batch to batch at once. The broker's ends are driven by hand here, so no port is opened."""

import io
import json
import socket
import threading
from types import SimpleNamespace

import pytest

from millrace.providers import leases as L
from millrace.providers.pool import ServerPool
from millrace.queries import LastMessageProvider


class Link:
    """A connection's transport that keeps what is said."""

    def __init__(self, talk):
        self.talk, self.said, self.closed = talk, [], False

    def write(self, data):
        self.said.append(json.loads(data))

    def is_closing(self):
        return self.closed

    def close(self):
        if not self.closed:
            self.closed = True
            self.talk.connection_lost(None)

    abort = close


class Task:
    def __init__(self, broker, first=0, secret=None):
        self.talk, self.first = L._Talk(broker), first
        self.talk.connection_made(Link(self.talk))
        self.hear({"secret": secret or broker.secret})

    def hear(self, *lines):
        self.talk.data_received("".join(f"{json.dumps(line)}\n" for line in lines).encode())

    def take(self):
        self.hear({"ask": "take", "first": self.first})
        return self.said

    def give(self, reached=True):
        self.hear({"ask": "give", "reached": reached})

    @property
    def said(self):
        return self.talk.link.said[-1] if self.talk.link.said else "nothing"


@pytest.fixture
def clock(monkeypatch):
    now = SimpleNamespace(at=100.0)
    monkeypatch.setattr(L, "time", SimpleNamespace(monotonic=lambda: now.at))
    return now


@pytest.fixture
def broker_of():
    made = []

    def make(*args, **kwargs):
        made.append(L.LeaseBroker(*args, **kwargs))
        return made[-1]

    yield make
    for broker in made:
        broker._loop.close()


def test_lines_are_not_held_back_until_the_last_is_acknowledged():
    done = []

    class Recorded:
        def setsockopt(self, *option):
            done.append(option)

        def makefile(self, mode):
            done.append("file")
            return io.BytesIO()

        def close(self):
            pass

    task = L.Leases(L.LeaseAddress("nowhere", 1, "s"), connect=lambda address: Recorded())
    task.give()
    assert done == [(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1), "file"]


def test_a_free_quick_server_is_taken_before_a_free_slow_one(broker_of, clock):
    """A task alone, whose own server is the slow one, leaves it once both are known."""
    task, taken = Task(broker_of(2, 1)), []
    for _ in range(20):
        taken.append(task.take())
        clock.at += (0.05, 0.001)[taken[-1]]
        task.give()
    assert taken == [0] + 19 * [1]


def test_the_least_busy_comes_before_the_quickest(broker_of, clock):
    broker = broker_of(2, 2)
    broker.pace = {0: 0.05, 1: 0.001}
    assert [Task(broker).take() for _ in range(5)] == [1, 0, 1, 0, "nothing"]


def test_those_that_wait_are_served_in_order(broker_of):
    broker = broker_of(1, 1)
    a, b, c, d = (Task(broker, k) for k in range(4))
    assert [a.take(), c.take(), b.take(), d.take()] == [0, "nothing", "nothing", "nothing"]
    a.give()
    assert (b.said, c.said, d.said) == ("nothing", 0, "nothing")
    b.talk.link.close()  # it dies while it waits, and takes no place
    c.talk.link.close()  # it dies while it holds one
    assert (b.said, d.said) == ("nothing", 0)
    assert len(broker.pace) == 1
    before = dict(broker.pace)
    e = Task(broker)
    e.talk.link.close()
    d.talk.link.close()
    assert broker.pace == before  # what a dead task held tells no pace
    d = Task(broker)
    assert d.take() == 0
    d.give()
    assert not any(broker.busy.values()) and broker.talks == {a.talk, d.talk} and not broker.waiting


def test_a_place_waited_for_comes_when_a_server_is_tried_again(broker_of, clock):
    broker = broker_of(2, 1, away=30)
    one, two, three = (Task(broker, k) for k in range(3))
    assert (one.take(), two.take()) == (0, 1)
    one.give(reached=False)
    assert three.take() == "nothing"
    clock.at += 30.01
    broker.grant()  # what the loop calls then
    assert three.said == 0
    three.give(reached=False)
    assert three.take() == 0  # still what was said last: it waits for a server that may be left
    two.give(reached=False)
    assert three.said is None and one.take() is None


@pytest.mark.parametrize("broken", [b'{"ask": "take", "first": 0}\n', b"no json\n", b"[1]\n", b"7\n", b'{"ask": 1}{\n', b'{"give": 1}\n', b"x" * 100_000])
def test_connections_that_break_the_rules_lose_their_place(broker_of, broken):
    broker = broker_of(1, 1)
    one, two = Task(broker), Task(broker)
    assert one.take() == 0 and two.take() == "nothing"
    one.talk.data_received(broken)
    assert one.talk.link.closed and two.said == 0 and broker.talks == {two.talk}


def test_a_stranger_gets_nothing_and_lines_come_in_pieces(broker_of):
    broker = broker_of(1, 1)
    stranger = Task(broker, secret="guess")
    assert stranger.talk.link.closed and not broker.talks
    task = Task(broker)
    task.talk.data_received(b'{"ask": "ta')
    assert task.said == "nothing"
    task.talk.data_received(b'ke", "first": 0}\n{"ask": "give", "reached": true}\n{"ask": "take", "first": 0}\n')
    assert task.talk.link.said == [0, 0] and broker.busy[0] == 1


def test_one_batch_in_flight_needs_no_thread():
    seen = []
    with ServerPool([LastMessageProvider] * 2) as pool:
        found = list(pool.run(iter(range(5)), lambda client, b: seen.append(threading.current_thread()) or b, 1))
    assert found == [(k, k) for k in range(5)] and set(seen) == {threading.current_thread()}
