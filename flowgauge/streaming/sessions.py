"""Live sessions: the stream report kept up event by event, equal to the batch report on the same prefix."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "events array<long>, reads map<string,long>, n long, tokens long, duplicates long, pending long, peak long"
REPORT = "session_id long, n_events long, tokens long, duplicate_calls long, peak_unvalidated_edits long"


def advance(state: dict, rows: pd.DataFrame) -> dict:
    """The state after more events (event_id, seq, kind, path, tokens), in their order; a repeated event changes nothing."""
    for r in rows.sort_values("seq", kind="stable").itertuples():
        if r.event_id in state["seen"]:
            continue
        state["seen"].add(r.event_id)
        state["n"] += 1
        state["tokens"] += int(r.tokens)
        if r.kind in ("read", "edit"):
            key = f"{r.kind}:{r.path}"
            state["calls"][key] = state["calls"].get(key, 0) + 1
            state["duplicates"] += state["calls"][key] > 1
        if r.kind == "edit":
            state["pending"] += 1
            state["peak"] = max(state["peak"], state["pending"])
        elif r.kind == "check":
            state["pending"] = 0
    return state


def fresh() -> dict:
    return {"seen": set(), "calls": {}, "n": 0, "tokens": 0, "duplicates": 0, "pending": 0, "peak": 0}


def live_report(events: DataFrame) -> DataFrame:
    """A stateful stream over events (session_id, event_id, seq, kind, path, tokens); gives a session's report anew
    whenever it gets events. Ids are kept as long as a session's state is."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = fresh()
        if group.exists:
            seen, calls, n, tokens, duplicates, pending, peak = group.get
            state = {"seen": set(seen), "calls": dict(calls), "n": n, "tokens": tokens, "duplicates": duplicates, "pending": pending, "peak": peak}
        state = advance(state, pd.concat(list(batches)))
        group.update((sorted(state["seen"]), state["calls"], state["n"], state["tokens"], state["duplicates"], state["pending"], state["peak"]))
        yield pd.DataFrame({"session_id": [key[0]], "n_events": [state["n"]], "tokens": [state["tokens"]], "duplicate_calls": [state["duplicates"]], "peak_unvalidated_edits": [state["peak"]]})

    return events.groupBy("session_id").applyInPandasWithState(step, REPORT, STATE, "update", GroupStateTimeout.NoTimeout)
