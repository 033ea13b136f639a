"""Runs of words, chunked BPE and fill-in-the-middle against brute force and the library, on the small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowgauge.llm import chunk_bpe, fill_middle, queries, runs

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "no id here at all"), (5, "İstanbul ΣΑΣ ﬁ ½ ́é 日本語 😀 'tis it's don't <|endoftext|> <P> x"), (6, "x" * 5000), (7, "word " * 3000), (8, "a b c " * 40 + "a b d " * 40), (9, "<|endoftext|><|endoftext|>  <|endoftext|>\n\n"), (10, "ab cd\x1ccd\x85 e" * 30)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return [(i + 100, t) for i, t in rows] + ODD


@pytest.fixture(scope="module")
def frame(spark, docs):
    # columns named like the operators' own results must not get in the way
    return spark.createDataFrame([(i, t, 7, [3], "plain", "mine") for i, t in docs], "doc_id long, text string, n long, ids array<int>, form string, runs string").repartition(5)


def counted(rows):
    out = {}
    for r in map(tuple, rows):
        out[r] = out.get(r, 0) + 1
    return out


def brute_runs(words):
    numbers = {}
    x = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    period = {}
    for q in range(1, len(words) // 3 + 1):
        d = np.diff(np.concatenate(([0], (x[q:] == x[:-q]).astype(int), [0])))
        for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)):
            if b - a + q >= max(24, 3 * q):
                period.setdefault((int(a), int(b) + q), q)
    return sorted((a, b - a, q) for (a, b), q in period.items())


def brute_digest(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    stays = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (key, len(found), *four, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(stays).encode()).hexdigest())


def test_runs_equal_brute_force(frame, docs):
    got = runs.digests(frame)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = counted(brute_digest(i, t) for i, t in docs)
    assert sum(r[1] > 0 for r in want) > 10
    assert counted(got.collect()) == want


def test_runs_and_collapsed_texts_are_given(spark):
    text = "x y " + "a b c " * 10 + "z"
    rows = spark.createDataFrame([(1, text), (2, None), (None, "a")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in runs.find(rows).collect()}
    assert got == {1: ([(2, 30, 3)], "x y a b c z"), 2: ([], ""), None: ([], "a")}
    assert runs.find(rows.limit(0)).count() == 0 and runs.digests(rows.limit(0)).count() == 0


def periodic(rng):
    """Words with runs beside, inside and across each other, and copies of stretches that hold runs."""
    words = [str(rng.randrange(rng.choice([1, 2, 3, 5, 50]))) for _ in range(rng.randrange(260))]
    for _ in range(rng.randrange(4)):
        if words:
            a, at = rng.randrange(len(words)), rng.randrange(len(words))
            words[at:at] = words[a : a + rng.randrange(1, 20)] * rng.randrange(1, 12)
    if words and rng.random() < 0.3:
        a = rng.randrange(len(words))
        words += words[a : rng.randrange(a, len(words))] * rng.randrange(1, 3)
    return words


def test_runs_of_many_shapes():
    rng = random.Random(1)
    seen = 0
    for _ in range(60):
        several = [periodic(rng) for _ in range(rng.randrange(12))]
        want = [brute_runs(w) for w in several]
        seen += sum(map(len, want))
        assert runs.runs(several) == want
    assert seen > 200


def test_runs_of_one_long_document():
    assert runs.runs([[str(k % 977) for k in range(200_000)]]) == [[(0, 200_000, 977)]]
    assert runs.runs([["a"] * 100_000, [], ["b"] * 23]) == [[(0, 100_000, 1)], [], []]


def test_suffixes_are_in_order():
    rng = np.random.default_rng(2)
    for size in (1, 2, 50, 300):
        x = rng.integers(1, 4, size)
        found = runs.suffixes(x)
        want = sorted(range(size), key=lambda k: x[k:].tolist())
        assert found.order.tolist() == want
        common = lambda a, b: next((k for k in range(size) if max(a, b) + k >= size or x[a + k] != x[b + k]), size)
        assert found.common.tolist() == [common(a, b) for a, b in zip(want, want[1:])]
        lengths, sources = runs.previous_factors(found.order.tolist(), [0, *found.common.tolist()])
        assert lengths == [max((common(i, j) for j in range(i)), default=0) for i in range(size)]
        assert all(not n or (s < i and common(s, i) == n) for i, (n, s) in enumerate(zip(lengths, sources)))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path(chunk_bpe.MODEL))
    t.no_truncation()
    t.no_padding()
    return t


def test_chunk_bpe_equals_the_library(frame, docs, library):
    def want(key, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert counted(chunk_bpe.round_trip(frame).collect()) == counted(want(i, t) for i, t in docs)


def test_chunk_bpe_ids_and_texts(spark, frame, docs, library):
    coded = chunk_bpe.encode(frame)
    assert counted((r.doc_id, tuple(r.ids)) for r in coded.collect()) == counted((i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs)
    assert counted(chunk_bpe.decode(coded).collect()) == counted((i, t or "") for i, t in docs)
    broken = spark.createDataFrame([(1, [158]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert counted(chunk_bpe.decode(broken).collect()) == counted([(1, library.decode([158])), (2, ""), (3, "")])
    assert chunk_bpe.encode(frame.limit(0)).count() == 0 and chunk_bpe.decode(broken.limit(0)).count() == 0


def test_joins_of_small_chunks_are_repaired(library, monkeypatch):
    for name, value in (("LEAST", 3), ("MOST", 40), ("BITS", 3), ("BLOCK", 64), ("CHUNKS", 50), ("PIECES", 50)):
        monkeypatch.setattr(chunk_bpe, name, value)
    bpe = chunk_bpe.ChunkBpe(public_tokenizers.path(chunk_bpe.MODEL), public_tokenizers.PATTERN)
    rng = random.Random(4)
    parts = ["a", "b", "'s", "'r", "e", " ", "  ", "\n", "1", "é", "日", "!", "<|endoftext|>", " ", "ll", "x" * 30, "\t", "ꟑ", "😀", "'l", "l", "ա", "\x1c", "½"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(120)))
        if rng.random() < 0.2:
            text = rng.choice([" ", "a", "1", "!", "日"]) * rng.randrange(300) + text
        assert array("I", bpe.encode(text)).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_shared_passages_are_encoded_once():
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000))
    bpe = chunk_bpe.ChunkBpe(public_tokenizers.path(chunk_bpe.MODEL), public_tokenizers.PATTERN)
    bpe.encode(passage)
    before = bpe.chunks.made
    bpe.encode("Other words stand before it here. " + passage + " And some after.")
    assert before > 20 and bpe.chunks.made <= before + 4


def test_classes_of_the_plain_engine_are_the_tokenizers(library):
    text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}{chr(c)}b\n" for c in range(chunk_bpe.KNOWN))
    bpe = chunk_bpe.load(public_tokenizers.path(chunk_bpe.MODEL), public_tokenizers.PATTERN)
    assert bpe.regex.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_cuts_cover_the_text_and_depend_on_it_alone():
    rng = random.Random(6)
    text = "".join(rng.choice("abc d\n") for _ in range(50_000))
    found = chunk_bpe.cuts(text)
    assert found[-1] == len(text) and all(chunk_bpe.LEAST <= b - a <= chunk_bpe.MOST for a, b in zip([0, *found], found[:-1]))
    moved = {c - 777 for c in chunk_bpe.cuts("z" * 777 + text)}
    assert len(moved & set(found)) > 0.9 * len(found)
    assert chunk_bpe.cuts("") == [] and chunk_bpe.cuts("a") == [1] and chunk_bpe.cuts("a" * 10_000) == [4096, 8192, 10_000]


def brute_middle(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}", "spm": f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"}[form]
    parts = (None, None) if form == "plain" else (a, b - a)
    return n, form, parts, out


def test_fill_middle_equals_brute_force(frame, docs):
    def want(key, text):
        n, form, parts, out = brute_middle(key, text)
        return key, n, form, *parts, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = fill_middle.digests(frame).collect()
    assert counted(got) == counted(want(i, t) for i, t in docs) and {r.form for r in got} == {"plain", "psm", "spm"}
    texts = counted((i, form, *parts, out) for i, t in docs for _, form, parts, out in [brute_middle(i, t)])
    assert counted(fill_middle.rewrite(frame).collect()) == texts
    assert fill_middle.rewrite(frame.limit(0)).count() == 0 and fill_middle.digests(frame.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["point", "line", "word"])
def test_units_are_counted_and_selected(unit):
    pattern = {"point": r"(?s).", "line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]*[^ \t-\r]+(?:[ \t-\r]+\Z)?|\A[ \t-\r]+\Z"}[unit]
    rng = random.Random(7)
    for text in ["", " ", "a", " a", "a ", "\n\n", "é 日\nb  "] + ["".join(rng.choice("aé日😀 \n\t") for _ in range(rng.randrange(60))) for _ in range(200)]:
        stops = [len(text[: m.end()].encode()) - 1 for m in re.finditer(pattern, text)]
        bits = fill_middle.ends(text.encode(), unit)
        assert [fill_middle.select(bits, k) for k in range(bits.bit_count())] == stops, (text, unit)
    with pytest.raises(IndexError):
        fill_middle.select(5, 2)


def test_outputs_are_taken_apart_where_parts_look_like_marks():
    for text in ("<", "<<P<S<M>", "P><S", "S>M>P>", "<P><"):
        for key in range(60):
            n, form, _, _, out = fill_middle.transform(text.encode(), key)
            assert fill_middle.restore(out, form) == text.encode() and n == len(text)


def test_new_queries_read_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op11_runs", "op12_chunk_bpe", "op13_fill_middle"):
        out = queries.queries()[name](spark, sf_dir)
        assert out.count() == n and out.where(F.col("doc_id").isNull()).count() == 0
