"""Sequential operators: what depends on decisions made before, folded in order within a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.functions.scalars import cosine


def fold(df: DataFrame, by: str, order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run over each session's rows in order. A task takes many sessions, sorted by Spark, one after the other; it holds one
    batch, or one session where that is longer."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            key, out = b[by].to_numpy(), []
            fresh = np.nonzero([x != y and not (x is y or pd.isna(x) and pd.isna(y)) for x, y in zip(key[1:], key[:-1])])[0] + 1
            if held and len(b):
                x, y = held[-1][by].iloc[-1], key[0]
                if x != y and not (pd.isna(x) and pd.isna(y)):
                    out.append(run(pd.concat(held, ignore_index=True)))
                    held = []
            begins = [0, *fresh.tolist()]
            for k, begin in enumerate(begins[:-1]):
                part = b.iloc[begin : begins[k + 1]].reset_index(drop=True)
                out.append(run(pd.concat([*held, part], ignore_index=True) if held else part))
                held = []
            if len(b):
                held.append(b.iloc[begins[-1] :])
            if out:
                yield pd.concat(out, ignore_index=True)
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(each, schema)


def sliding_intents(vectors: DataFrame, split: float = 0.45, length: int = 5) -> DataFrame:
    """Segments of prompts (session_id, seq, vec): a new one begins below the similarity, or when one is full.

    The length resets where a segment begins, so that this is a fold, one step a row.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("seq")
    near = vectors.select("session_id", "seq", F.lag("vec").over(w).alias("before"), "vec").select("session_id", "seq", F.when(F.col("before").isNull(), 0.0).otherwise(cosine(F.col("before"), F.col("vec"))).alias("near"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        segment, size, out = 0, 0, []
        for close in p["near"].to_numpy():
            if size and (close < split or size >= length):
                segment, size = segment + 1, 0
            size += 1
            out.append(segment)
        return p[["session_id", "seq"]].assign(segment=np.array(out, np.int32))

    return fold(near, "session_id", ["seq"], run, f"session_id {dict(vectors.dtypes)['session_id']}, seq long, segment int")


def ema(vectors: DataFrame, alpha: float = 0.3) -> DataFrame:
    """The running intent of a session (session_id, seq, vec): an exponential mean, drawn to length one at each step."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        now, drift = None, []
        for v in p["vec"]:
            v = np.asarray(v, np.float64)
            before = now
            now = v if now is None else alpha * v + (1 - alpha) * now
            now = now / (np.linalg.norm(now) or 1.0)
            drift.append(0.0 if before is None else round(float(1 - before @ now), 6))
        return pd.DataFrame({"session_id": p["session_id"], "seq": p["seq"], "drift": drift})

    return fold(vectors, "session_id", ["seq"], run, "session_id long, seq long, drift double")


def knapsack(items: DataFrame, budget: int, exact: int = 500, quantum: int = 100) -> DataFrame:
    """The most relevant items (session_id, item, tokens, relevance) within a budget of tokens: by dynamic programming over
    quanta for up to `exact` items, by relevance per token beyond."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        tokens, worth = p["tokens"].to_numpy(), p["relevance"].to_numpy()
        able = np.nonzero(worth >= 0.1)[0]
        tokens, worth = tokens[able], worth[able]
        if tokens.sum() <= budget:
            chosen = np.arange(len(able))
        elif len(able) <= exact:
            room, cost = max(1, budget // quantum), np.maximum(1, tokens // quantum)
            best, taken = np.zeros(room + 1), np.zeros((len(able), room + 1), bool)
            for k, (c, v) in enumerate(zip(cost.tolist(), worth.tolist())):
                if c <= room:
                    more = best[: room + 1 - c] + v
                    np.greater(more, best[c:], out=taken[k, c:])
                    np.maximum(best[c:], more, out=best[c:])
            chosen, left = [], room
            for k in range(len(able) - 1, -1, -1):
                if taken[k, left]:
                    chosen.append(k)
                    left -= int(cost[k])
            chosen = np.array(chosen[::-1], np.int64)
        else:
            used, kept = 0, []
            for k in np.lexsort((p["item"].to_numpy()[able], -worth / np.maximum(1, tokens))).tolist():
                if used + tokens[k] <= budget:
                    kept.append(k)
                    used += int(tokens[k])
            chosen = np.sort(np.array(kept, np.int64))
        return p.iloc[able[chosen]][["session_id", "item", "tokens"]]

    return fold(items, "session_id", ["item"], run, "session_id long, item long, tokens long")


def interventions(signals: DataFrame, floor: float = 0.7, cooldown: int = 20, least: int = 1, evidence: int = 1) -> DataFrame:
    """Verdicts on signals (session_id, position, signal_id, detector, confidence, n_evidence), one policy a detector: too
    little evidence, low confidence, still cooling down, not enough of them yet, or advised; none is advised twice."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        fired: dict[str, int] = {}
        pending: dict[str, int] = {}
        done: set[tuple[str, str]] = set()
        out = []
        for r in p.itertuples():
            key = (r.detector, r.signal_id)
            if key in done:
                out.append(None)
            elif r.n_evidence < evidence:
                out.append("no_evidence")
            elif r.confidence < floor:
                out.append("low_confidence")
            elif r.detector in fired and r.position - fired[r.detector] < cooldown:
                out.append("cooldown")
            else:
                pending[r.detector] = pending.get(r.detector, 0) + 1
                if pending[r.detector] < least:
                    out.append("below_hysteresis")
                else:
                    pending[r.detector], fired[r.detector] = 0, r.position
                    done.add(key)
                    out.append("advised")
        return p.assign(verdict=out).dropna(subset=["verdict"])[["session_id", "position", "signal_id", "detector", "verdict"]]

    return fold(signals, "session_id", ["position", "signal_id"], run, "session_id long, position long, signal_id string, detector string, verdict string")


def excessive_planning(steps: DataFrame, least: int = 4, novelty: float = 0.25) -> DataFrame:
    """Findings for runs of `least` or more planning steps (see flowgauge.operators.steps) in a row, without the results of
    plan calls: in each, from the third step on, reasoning of whose words at most a share `novelty` is new to the prompt and
    the run, and plan calls that repeat one of the run. One row for such a step: session_id, run (its first idx), idx, and
    the finding's confidence, 0.55 and 0.05 for each step of the run, 0.9 at most."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        part: list = []
        prompt: set[str] = set()

        def judged() -> None:
            known, keys, extra = set(prompt), set(), []
            for place, r in enumerate(part):
                mine = set(r.words)
                again = (len(mine - known) / len(mine) if mine else 0.0) <= novelty if r.kind == "reasoning" else r.call_key in keys
                if place >= 2 and again:
                    extra.append(r.idx)
                known |= mine
                keys.add(r.call_key)
            if len(part) >= least:
                out.extend((part[0].session_id, part[0].idx, x, round(min(0.9, 0.55 + 0.05 * len(part)), 4)) for x in extra)
            part.clear()

        for r in p.itertuples():
            if r.kind == "completion" and r.tool_kind == "plan":
                continue
            if r.kind == "reasoning" or (r.kind == "request" and r.tool_kind == "plan"):
                part.append(r)
                continue
            judged()
            if r.kind == "prompt":
                prompt = set(r.words)
        judged()
        return pd.DataFrame(out, columns=["session_id", "run", "idx", "confidence"])

    taken = steps.select("session_id", "idx", "kind", "tool_kind", "call_key", "words")
    return fold(taken, "session_id", ["idx"], run, "session_id string, run long, idx long, confidence double")


def bootstrap(records: DataFrame, by: str, samples: int = 400, seed: int = 17) -> DataFrame:
    """Mean of a score (by, id, score) with its 95 % interval, by resampling within each group."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x = p["score"].to_numpy(np.float64)
        rng = np.random.default_rng(seed)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(samples)])
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({by: [p[by].iloc[0]], "n": [len(x)], "mean": [round(float(x.mean()), 6)], "low": [round(float(low), 6)], "high": [round(float(high), 6)]})

    kind = dict(records.dtypes)[by]
    return fold(records, by, ["id"], run, f"{by} {kind}, n long, mean double, low double, high double")
