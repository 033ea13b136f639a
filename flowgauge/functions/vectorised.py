"""Functions that Spark's own can't express, as pandas UDFs over Arrow batches: embeddings, tool fingerprints and text
segments. Shell lines are in flowgauge.functions.shell."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DIMENSION = 384
_FEATURE = re.compile(r"[a-z0-9_]+")
VOLATILE = {"timestamp", "request_id", "uuid", "id"}


def _embed(text: str | None) -> list[float]:
    words, v = _FEATURE.findall((text or "").lower()), np.zeros(DIMENSION, np.float32)
    for feature in [*words, *map(" ".join, zip(words, words[1:]))]:
        n = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")
        v[n % DIMENSION] += 1 if n >> 63 else -1
    size = float(np.linalg.norm(v))
    return (v / size if size else v).tolist()


@pandas_udf(T.ArrayType(T.FloatType()))
def embedding(text: pd.Series) -> pd.Series:
    """Signed feature hashing of words and word pairs, of length one."""
    return text.map(_embed)


def _canonical(value: object) -> object:
    if isinstance(value, dict):
        return {k: _canonical(v) for k, v in sorted(value.items()) if k not in VOLATILE}
    if isinstance(value, list):
        return [_canonical(v) for v in value]
    return " ".join(value.split()) if isinstance(value, str) else value


@lru_cache(maxsize=1 << 14)
def _sorted_json(text: str | None) -> str:
    try:
        return json.dumps(json.loads(text or "{}"), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return text or ""


@pandas_udf(T.StringType())
def canonical_json(value: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks, so that equal values are equal texts; what isn't JSON stays as it is."""

    return value.map(_sorted_json)


@pandas_udf(T.StringType())
def tool_fingerprint(name: pd.Series, arguments: pd.Series) -> pd.Series:
    """A digest of a tool's name and its arguments in canonical JSON."""

    def one(n: str | None, a: str | None) -> str:
        try:
            value = json.loads(a) if a else {}
        except ValueError:
            value = {"raw": a}
        text = json.dumps(_canonical(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(f"{(n or '').strip().casefold()}\0{text}".encode()).hexdigest()

    return pd.Series([one(n, a) for n, a in zip(name, arguments)])


_encoders: dict[tuple[str, str], object] = {}


def bpe_count(path: str, pattern: str) -> Callable:
    """A column function: the number of byte-pair tokens of a text, by the ranks in a file (base64 token and rank a line) and a
    pattern of pre-tokens; each worker reads the file once. An empty or null text has none."""

    @pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        return text.map(lambda t: len(_encoders[path, pattern].encode_ordinary(t)) if t else 0)

    return count


_BREAK, _SENTENCE = re.compile(r"\n\s*\n|\n(?=#{1,6}\s)"), re.compile(r"(?<=[.!?])\s+")


def segment(text: str | None, least: int = 12, most: int = 180) -> list[tuple[int, int]]:
    """Spans of a text: paragraphs, long ones split at sentences and small ones joined to the one before."""
    text, size = text or "", lambda a, b: max(1, (b - a) // 4)
    pieces, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        cuts, start = [x.end() for x in _SENTENCE.finditer(text, at, end)] if size(at, end) > most else [], at
        for k, cut in enumerate([*cuts, end]):
            following = cuts[k + 1] if k + 1 < len(cuts) else end
            if cut == end or size(start, following) > most:
                pieces.append((start, cut))
                start = cut
        at = m.end() if m else end
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        raw = text[a:b]
        a, b = a + len(raw) - len(raw.lstrip()), b - len(raw) + len(raw.rstrip())
        if b <= a:
            continue
        if out and size(a, b) < least and size(out[-1][0], b) <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def segments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"start": a, "end": b} for a, b in segment(t)])
