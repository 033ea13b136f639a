"""Spans against the last ten of their phase: a session's spans in order, a ring of sets for each phase."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

RING = 10
SETS = ("f", "t", "things", "acts")


def _jaccard(a: set, b: set, empty: float) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else empty


def _likeness(old: tuple, now: tuple, tool: bool) -> float:
    """The blended score of two spans: (four sets, tool name, facts, arguments)."""
    (f, t, things, acts), name, facts, arguments = old
    (g, u, others, does), named, given, whole = now
    same = name is not None and name == named
    if tool and same and arguments is not None and arguments == whole:
        return 1.0
    sem = len(f & g) / sqrt(len(f) * 1.0 * len(g)) if f and g else 0.0
    lex, ent, act = _jaccard(t, u, 1.0), _jaccard(things, others, 1.0), _jaccard(acts, does, 0.0)
    if not tool:
        return (0.82 * sem + 0.18 * (0.45 * lex + 0.3 * ent + 0.25 * act)) * (1.0 - 0.3 * (1.0 - ent))
    if name is not None and named is not None and name != named:
        new = 1.0
    elif facts != given:
        new = sum(x != y for x, y in zip(facts, given)) / 4.0
    else:
        new = 0.25 if arguments is not None and whole is not None and arguments != whole else 0.0
    return (0.45 * sem + 0.15 * lex + 0.1 * ent + 0.3 * (1.0 if same else 0.0)) * (1.0 - 0.85 * new)


def top_match(spans: DataFrame) -> DataFrame:
    """spans (session_id, seq, phase, SETS, tool_name, facts, arguments and more), partitioned by session_id and sorted by it
    and seq, without SETS but f, and with score and earlier: the greatest likeness to one of the last RING spans of the phase
    in the session, 0 if there is none, and the first span that has it. A task holds a batch and a ring for each phase."""
    kept = [x for x in spans.schema.fields if x.name not in (*SETS[1:], "tool_name", "facts", "arguments")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, rings = None, defaultdict(lambda: deque(maxlen=RING))
        for b in batches:
            scores, earlier = [], []
            columns = [b.column(c).to_pylist() for c in ("session_id", "seq", "phase", *SETS, "tool_name", "facts", "arguments")]
            for key, seq, phase, *sets, name, facts, arguments in zip(*columns):
                if key != session:
                    session = key
                    rings.clear()
                # a span without text is like none
                now = None if None in sets else (tuple(map(set, sets)), name, facts, arguments)
                score, first, ring = 0.0, None, rings[phase]
                for at, old in ring:
                    if old is not None and now is not None and (near := _likeness(old, now, phase == "tool_use")) > score:
                        score, first = near, at
                ring.append((seq, now))
                scores.append(score)
                earlier.append(first)
            yield pa.RecordBatch.from_arrays([*(b.column(x.name) for x in kept), pa.array(scores, pa.float64()), pa.array(earlier, pa.int64())], [*(x.name for x in kept), "score", "earlier"])

    return spans.mapInArrow(run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("earlier", T.LongType())]))
