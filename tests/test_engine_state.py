"""The incremental engine's state: few reads and writes a session, and buckets that split without losing anything."""

import random
from collections import Counter

import pandas as pd
import pytest

from flowgauge.streaming import engine

COLUMNS = ["session_id", "event_id", "seq", "call", "mark", "request_id", "used"]


class Value:
    v = None

    def __init__(self, calls):
        self.calls = calls

    def exists(self):
        self.calls["read"] += 1
        return self.v is not None

    def get(self):
        self.calls["read"] += 1
        return self.v

    def update(self, v):
        self.calls["write"] += 1
        self.v = v


class Map(dict):
    def __init__(self, calls):
        self.calls = calls

    def containsKey(self, k):
        self.calls["read"] += 1
        return k in self

    def getValue(self, k):
        self.calls["read"] += 1
        return self[k]

    def updateValue(self, k, v):
        self.calls["write"] += 1
        self[k] = v

    def iterator(self):
        self.calls["read"] += 1
        return iter(sorted(self.items(), reverse=True))


def started(calls):
    handle = type("Handle", (), {"getValueState": lambda self, *a: Value(calls), "getMapState": lambda self, *a: Map(calls)})()
    e = engine.Engine()
    e.init(handle)
    return e


def events(n, seed):
    draw = random.Random(seed)
    rows = [("x", f"e{k}", k, draw.choice([None, "Read {}", "Edit {}", f"Read {draw.randrange(n)}"]), draw.choice([None, "edit", "edit", "check"]), draw.choice([None, f"q{k // 2}"]), 7) for k in range(n)]
    rows += draw.sample(rows, n // 3)
    draw.shuffle(rows)
    return rows


def plain(rows):
    once = list({r[1]: r for r in rows}.values())
    asked, calls = {r[5] for r in once if r[5]}, [r[3] for r in once if r[3]]
    return ["x", len(once), len(asked), 7 * len(asked), len(calls) - len(set(calls)), engine.peak([(r[2], r[4]) for r in once if r[4]]), False]


def told(e, frames):
    (report,) = e.handleInputRows(("x",), iter(frames), None)
    return report.values.tolist()[0]


def test_a_small_session_is_read_and_written_once_a_batch():
    calls = Counter()
    e, rows = started(calls), events(150, 1)
    for k, part in enumerate((rows[:90], rows[90:]), 1):
        got = told(e, [pd.DataFrame(part, columns=COLUMNS)])
        assert calls == {"read": k, "write": k}
    assert got == plain(rows)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_buckets_and_blocks_keep_all_of_a_long_session(monkeypatch, size):
    for name, n in {"ALONE": 8, "SHARED": 2, "BLOCK": 5, "ROWS": 3}.items():
        monkeypatch.setattr(engine, name, n)
    e, rows = started(Counter()), events(160, 2)
    for first in range(0, len(rows), size):
        frame = pd.DataFrame(rows[first : first + size], columns=COLUMNS)
        assert told(e, [frame[:2], frame[2:]]) == plain(rows[: first + size])
    assert len(e.kept) > 64 and len(e.marks) > 20
    assert max(len(v.split()) for (v,) in e.kept.values()) < 16


def test_a_long_session_is_not_read_whole():
    calls = Counter()
    e, rows = started(calls), events(20000, 3)
    told(e, [pd.DataFrame(rows, columns=COLUMNS)])
    calls.clear()
    more = ("x", "new", 20001, "Edit new", "edit", "new", 7)
    assert told(e, [pd.DataFrame([more], columns=COLUMNS)]) == plain([*rows, more])
    assert calls["read"] + calls["write"] < 15
