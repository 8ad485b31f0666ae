"""Runs that never overlap."""

import threading

import pytest

from notefold.streaming.schedule import Refresher, Runner


def test_a_request_while_running_is_refused():
    seen = []
    runner = Runner(lambda: seen.append(runner.request()))
    assert runner.request() and seen == [False] and runner.request()


def test_ticks_until_stopped():
    stop, n = threading.Event(), []
    Runner(lambda: (n.append(1), stop.set() if len(n) == 3 else None)).every(0.001, stop)
    assert len(n) == 3


def test_requests_while_refreshing_become_one():
    n = []

    def work():
        n.append(1)
        if len(n) == 1:
            r.request()
            r.request()

    r = Refresher(work)
    r.request()
    assert len(n) == 2
    r.request()
    assert len(n) == 3


def test_a_failed_refresh_does_not_block_the_next():
    n = []

    def work():
        n.append(1)
        if len(n) == 1:
            raise ValueError

    r = Refresher(work)
    with pytest.raises(ValueError):
        r.request()
    r.request()
    assert len(n) == 2
