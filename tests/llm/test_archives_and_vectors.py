"""WARC round trips and damage, exact and approximate search, and the pipeline, against brute force."""

import hashlib
import io
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowgauge.llm import ann, blocks, queries, topk, warc

PAGES = [(1, "http://a", "x" * 99), (2, "http://a", "x" * 99), (3, "u", "é" * 50), (4, None, "é" * 50), (5, "u\r\nEvil: 1", None), (6, "u", ""), (None, "u", "é" * 50), (3, "v", "é" * 50), (9, "u", "a\r\n\r\nb" * 40), (7, "u", "long " * 100_000)]


def page_rows(pages):
    first = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    out = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        again = len(data) >= 100 and h in first and (i is None or i > first[h])
        out[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None] += 1
    return out


def test_warc_round_trip(spark, sf_dir, tmp_path):
    rows = [(r.page_id + 100, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + PAGES
    rows += [(k + 10_000, "c", "copy " * 30) for k in range(300)]
    pages = spark.createDataFrame([(*r, "x", True) for r in rows], "page_id long, url string, html string, digest string, revisit boolean").repartition(3)
    got = warc.round_trip(pages, f"file://{tmp_path}/w")
    assert Counter(map(tuple, got.collect())) == page_rows(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_hot_payloads_are_decided_as_any_others(spark, tmp_path, monkeypatch):
    # 3 hot payloads at most: one of two thirds of the rows, one whose rows all have one id, one whose ids are null but for two
    rows = [(k, "u", "hot " * 40) for k in range(600, 0, -1)] + [(7, "u", "same id " * 20)] * 200
    rows += [(None, None, "no id " * 30)] * 150 + [(9, "u", "no id " * 30), (8, "u", "no id " * 30)] + [(1000 + k, "u", f"pair {k % 10} " * 20) for k in range(20)]
    rows += [(2000, "u", "x" * 3_000_000), (2001, "u", "x" * 3_000_000)]
    for hot in (3, 1000):
        monkeypatch.setattr(warc, "HOT", hot)
        pages = spark.createDataFrame([(*r, "mine", "x") for r in rows], "page_id long, url string, html string, first string, hot string").repartition(4)
        assert Counter(map(tuple, warc.round_trip(pages, f"file://{tmp_path}/{hot}").collect())) == page_rows(rows)


def archive(payloads, **more):
    out = io.BytesIO()
    records = [warc.record(k, "u", p, hashlib.sha256(p).hexdigest(), len(p), None, False) for k, p in enumerate(payloads)]
    warc.write_archive(records, [], out)
    return out.getvalue(), records


def test_archive_is_read_frame_by_frame(monkeypatch):
    data, records = archive([b"page %d " % k * 50 for k in range(60)])
    assert list(warc.read_archive(io.BytesIO(data))) == records
    # another skippable frame between records is passed over
    assert list(warc.read_archive(io.BytesIO(data + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"))) == records


@pytest.mark.parametrize("spoil", [lambda d: d[:-9], lambda d: d[4:], lambda d: d[:20], lambda d: d + b"junkjunk", lambda d: d[:-40] + bytes([d[-40] ^ 255]) + d[-39:]])
def test_damaged_archives_are_refused(spoil):
    data, _ = archive([b"page %d " % k * 50 for k in range(60)])
    with pytest.raises(warc.Damaged):
        for r in warc.read_archive(io.BytesIO(spoil(data))):
            warc.parse(r)


@pytest.mark.parametrize("spoil", [lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"), lambda r: r.replace(b"WARC-Date", b"WARC-Dote"), lambda r: r.replace(b"hello", b"jello"), lambda r: r.replace(b"\r\nWARC-Type", b"\r\nno colon here\r\nWARC-Type"), lambda r: r[:-2]])
def test_damaged_records_are_refused(spoil):
    good = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), 5, None, False)
    assert warc.parse(good)[1] == b"hello"
    with pytest.raises(warc.Damaged):
        warc.parse(spoil(good))


def test_headers_that_have_not_their_form_are_refused():
    digest = hashlib.sha256(b"hello").hexdigest()
    good, again = warc.record(1, "u", b"hello", digest, 5, None, False), warc.record(2, "u", b"hello", digest, 5, 1, True)
    assert warc.parse(again)[0]["warc-refers-to-page-id"] == "1"
    for record, old, new in (
        (good, b"WARC-Target-URI: u", b"WARC-Target-URI: \xff"), (good, b"Content-Length: ", "Content-Length: ²".encode()), (good, b"WARC-Type: response", b"WARC-Type: banana"),
        (good, b"WARC-Page-ID: 1", b"WARC-Page-ID: 1\r\nWARC-Page-ID: 2"), (again, b"WARC-Payload-Length: 5", b"WARC-Payload-Length: five"), (again, b"sha256:" + digest.encode(), b"sha256:" + digest.upper().encode()), (again, b"Refers-To-Page-ID: 1", b"Refers-To-Page-ID: one"),
    ):
        assert old in record
        with pytest.raises(warc.Damaged):
            warc.parse(record.replace(old, new, 1))


ODD = [(1000, None), (1050, [1.0, None]), (1100, [float("nan"), 1.0]), (1150, [float("inf"), 1.0]), (1200, [0.0, 0.0]), (None, [1.0, 1.0]), (1300, [1.0, 2.0, 3.0]), (1301, [1.0, 2.0, 3.0]), (1400, []), (1500, [1e30, 1.0]), (1501, [-1e30, 2.0])]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(700, 16)))]
    rows += [(2000 + k, [0.5] * 16) for k in range(60)] + [(2000, [0.5] * 16), (40, rows[3][1])]
    return rows + ODD


@pytest.fixture(scope="module")
def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 3, 1.0) for i, v in vectors], "vec_id long, embedding array<float>, label int, score double").repartition(4)


def whole(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(vectors, every, k, score):
    out = {}
    for q, v in vectors:
        if q is not None and q % every == 0 and q not in out:
            found = [(-score(v, c), i) for i, c in vectors if i is not None and i != q and len(c) == len(v)]
            out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def grouped(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_topk_equals_brute_force(frame, vectors):
    cut = lambda n: max(-(1 << 63), min((1 << 63) - 1, n))
    score = lambda a, b: cut(sum(math.floor(256 * float(np.float32(x))) * math.floor(256 * float(np.float32(y))) for x, y in zip(a, b)))
    # a query id that occurs twice with different vectors is asked once, with either
    want = {q: r for q, r in brute([(i, v) for i, v in vectors if whole(v)], 50, 5, score).items() if r}
    assert dict(grouped(topk.top(frame))) == want


def test_topk_of_large_numbers_equals_brute_force():
    rng = np.random.default_rng(7)
    clip = lambda n: max(topk.LEAST, min(topk.MOST, n))
    whole = lambda x: math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256
    for size in (1e3, 1e7, 1e9, 1e16, 1e307):
        c, q = rng.normal(size=(300, 6)) * size * 0.2, rng.normal(size=(5, 6)) * min(size, 1e9) * 0.2
        c[7], c[50:60] = c[8], c[60:70]
        ids = rng.permutation(300)
        for n, found, scores in topk.prepare(5)(ids, c)(np.array([3, 4, 900, 901, 902]), q):
            all_ = sorted((-clip(sum(whole(a) * whole(b) for a, b in zip(q[n].tolist(), row))), i) for i, row in zip(ids.tolist(), c.tolist()) if i != (3, 4, 900, 901, 902)[n])
            assert list(zip((-scores).tolist() if scores.min() > topk.LEAST else [-s for s in scores.tolist()], found.tolist())) == all_[:5]


def test_tables_of_a_block_are_made_once():
    rng = np.random.default_rng(2)
    for module, what in ((topk, topk.Table), (ann, ann.Index)):
        made = []
        before, what.__init__ = what.__init__, lambda self, *a: (made.append(1), before(self, *a))[1]
        try:
            ask = module.prepare(3)(np.arange(500), rng.normal(size=(500, 8)))
            for k in range(4):
                assert len(list(ask(np.arange(k, k + 2), rng.normal(size=(2, 8))))) == 2
        finally:
            what.__init__ = before
        assert made == [1]


@pytest.mark.parametrize("dim", [1, 2, 8, 64])
def test_topk_with_one_vector_that_dwarfs_many_blocks(spark, dim):
    rng = np.random.default_rng(dim)
    numbers = rng.integers(-1, 2, (20_000, dim))
    numbers[50 * int(rng.integers(400))] = rng.integers(-256 * 10**9, 256 * 10**9, dim)
    rows = [(k, (n / 256).tolist()) for k, n in enumerate(numbers)]
    got = grouped(topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)))
    for q in range(0, 20_000, 50):
        score = numbers @ numbers[q]
        score[q] = np.iinfo(np.int64).min
        best = np.lexsort((np.arange(20_000), ~score))[:5]
        assert got[q] == list(zip(best.tolist(), score[best].tolist()))


def test_bounds_of_a_block_hold_where_a_query_dwarfs_it():
    rng = np.random.default_rng(5)
    c = rng.integers(-1, 2, (3000, 2))
    table = topk.prepare(5)(np.arange(3000), c / 256)
    for size in (1e6, 1e8, 1e9, 1e10, 3e10, 1e14):
        q = np.floor(rng.normal(size=(40, 2)) * size * 256)
        for n, found, scores in table(np.arange(5000, 5040), q / 256):
            score = [sum(int(a) * int(b) for a, b in zip(q[n], row)) for row in c.tolist()]
            best = sorted(range(3000), key=lambda k: (-score[k], k))[:5]
            assert found.tolist() == best and scores.tolist() == [score[k] for k in best]


def test_windows_expand_until_enough_collide():
    rng = np.random.default_rng(6)
    index, q = ann.Index(rng.normal(size=(3000, 12)), np.arange(3000), 10), rng.normal(size=(20, 12))
    windows = index.windows(q)
    for n in range(20):
        ends = [windows.ends(r, n) for r in range(ann.ROUNDS + 1)]
        assert all((a[0] >= b[0]).all() and (a[1] <= b[1]).all() for a, b in zip(ends, ends[1:])) and (ends[-1][0] == 0).all() and (ends[-1][1] == 3000).all()
        # the first windows are small, and no point is counted before a window passes it
        assert (ends[0][1] - ends[0][0]).mean() < 900 and (windows.middle(n) >= ends[0][0]).all() and (windows.middle(n) <= ends[0][1]).all()
        for lo, hi in ends:
            counts = sum(np.isin(np.arange(3000), index.order[h, lo[h] : hi[h]]).astype(int) for h in range(ann.HASHES))
            near = np.nonzero(counts >= index.need)[0]
            if len(near) >= index.enough:
                break
        score = index.rows[near] @ q[n]
        assert index.search(q[n], -1, windows, n)[0].tolist() == [int(index.ids[near[k]]) for k in np.lexsort((index.ids[near], -score))[:10]]


def test_recall_over_several_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(blocks, "CANDIDATES", 2048)
    given = np.array([r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()], float)
    rng = np.random.default_rng(8)
    rows = given[rng.integers(len(given), size=8000)] + rng.normal(size=(8000, given.shape[1])) * given.std() * 0.5
    table = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id long, embedding array<double>").repartition(3)
    got, hit, all_ = grouped(ann.nearest(table)), 0, 0
    for q in range(0, 8000, 20):
        score = rows @ rows[q]
        score[q] = -np.inf
        edge = np.sort(score)[-20]
        hit += sum(s >= edge - 1e-9 for _, s in got[q])
        all_ += 20
    assert hit >= 0.9 * all_


@pytest.mark.parametrize(("run", "k"), [(topk.top, 5), (ann.nearest, 20)])
def test_query_ids_repeated_among_equal_vectors_lose_no_others(spark, run, k):
    same, low = [0.5, 0.25], [0.25, 0.25]
    rows = [(0, same)] * 3 + [(i, same) for i in range(1, 2 * k)] + [(100, same)] * (2 * k + 3) + [(7, same)] * 2 + [(200 + i, low) for i in range(2 * k)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = grouped(run(table, 100, k))
    for q in (0, 100):
        assert [i for i, _ in got[q]] == sorted(i for i, v in rows if i != q and v is same)[:k]


def test_rows_needed_equal_brute_force():
    rng = np.random.default_rng(5)
    for n, kinds, k in ((40, 12, 3), (60, 4, 5), (1, 1, 2), (80, 30, 1)):
        ids, group = rng.integers(0, kinds, n), np.sort(rng.integers(0, 3, n))
        ids = ids[np.lexsort((ids, group))]
        want = {i for g in set(group) for own in range(-1, kinds) for i in [i for i in range(n) if group[i] == g and ids[i] != own][:k]}
        new = np.concatenate([[True], group[1:] != group[:-1]])
        assert set(np.nonzero(blocks.needed(ids, new, k))[0]) == want


def test_nearest_has_true_scores_and_recall(frame, vectors):
    good = [(i, v) for i, v in vectors if whole(v) and any(v)]
    by = defaultdict(list)
    for i, v in good:
        by[i].append([float(np.float32(x)) for x in v])
    got = grouped(ann.nearest(frame))
    want = brute([(i, v) for i, v in good if i != 40], 20, 20, lambda a, b: sum(x * y for x, y in zip(a, b)))
    hit = total = 0
    for q, found in want.items():
        hit, total = hit + len({i for i, _ in found} & {i for i, _ in got[q]}), total + len(found)
        assert len(got[q]) == min(20, len(got[q])) and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        for i, s in got[q]:
            assert any(abs(s - sum(x * y for x, y in zip(a, b))) <= 1e-9 * max(1, abs(s)) for a in by[q] for b in by[i])
    assert hit / total >= 0.9


def test_recall_on_the_supplied_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, c = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got, hit, total = grouped(ann.nearest(table)), 0, 0
    for k in np.nonzero(ids % 20 == 0)[0]:
        s = c @ c[k]
        order = [x for x in np.lexsort((ids, -s)) if x != k][:20]
        hit, total = hit + len(set(ids[order].tolist()) & {i for i, _ in got[int(ids[k])]}), total + 20
    assert hit / total >= 0.9


def test_empty_vectors(frame):
    for run in (topk.top, ann.nearest):
        assert run(frame.limit(0)).collect() == [] and run(frame.where("embedding is null")).collect() == []


def test_pipeline_decisions_take_effect(spark, tmp_path):
    import corpus_pipeline
    from flowgauge.llm import toxicity

    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 80)), "en", "s", 1) for i in range(300)]
    labels = []
    for i in range(300):
        if i % 6 == 0:
            rows[i] = (i, rows[i][1] + " grumpf snorkwit", "en", "s", 1)
        labels.append((i, int(i % 6 == 0), 1))
    rows += [(1000, rows[1][1], "en", "s", 1), (1001, rows[1][1], "en", "s", 1), (1002, "password = hunter2hunter2 " + rows[2][1][:40], "en", "s", 1), (1003, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some ordinary words of a benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 3:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        sizes.append({r.doc_id for r in now.select("doc_id").collect()})
        if name == "secrets":
            assert now.where("doc_id = 1002").first().text.startswith("[secret] ")
    toxic = {i for i in range(300) if i % 6 == 0}
    assert len(toxic & sizes[0]) <= 2 and len(sizes[0]) >= 250
    assert sizes[0] - sizes[1] == {1000, 1001} and sizes[1] == sizes[2] == sizes[3]
    assert {name for name, _ in corpus_pipeline.STAGES} == {"toxicity", "simhash", "secrets", "packing"} and corpus_pipeline.ORACLE_SQL is None
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in again.collect()).keys() == Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in now.collect()).keys()
    assert toxicity.THRESHOLD == 0.3


def test_stages_take_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some ordinary words of a benchmark"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shape = "doc_id long, text string, lang string, source string, n_chars long, score double, fingerprint string, spans string, root int, `a b` string"
    rows = [(i, t, g, None, None, 1.0, "f", "s", 1, "x") for i, t, g in [(1, None, None), (1, None, None), (2, "", "en"), (3, "password = hunter2hunter2", "xx"), (3, "another text under the same id", "en"), (None, "no id", "en"), (4, "word " * 200_000, "de"), (5, "x" * 300_000, "fr")]]
    for given, n in ((rows, [8, 6, 6]), ([], [0, 0, 0])):
        docs = now = spark.createDataFrame(given, shape)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            if k < 3:
                assert now.columns == docs.columns and now.count() == n[k], name
        found = now.collect()
        assert sum(r.length for r in found if r.start == 0) <= sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in found}.values())
        assert {r.doc_id for r in found} == ({1, 3, 4, 5, None} if given else set())


def test_queries_have_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert zlib.crc32(b"7") % 4 in range(4) and F is not None
