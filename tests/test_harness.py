"""Redaction and the corpus import, contracts, manifests, routing runs, report sinks, the cache, the tail and the control loop."""

import json
import os
import shutil

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowgauge.functions import vectorised
from flowgauge.plans import harness_plans, ratio_plans, registry, repository_plans, sample_plans
from flowgauge.plans.catalog import Plan
from flowgauge.sources import contracts, redaction, reports, samples, transcripts
from flowgauge.sources.records import append_log
from flowgauge.streaming import live

ORDERS = "/root/testdata/sf0.001"


def rows(found, names):
    return sorted(str([round(r[names.index(n)], 6) if isinstance(r[names.index(n)], float) else r[names.index(n)] for n in sorted(names)]) for r in found)


@pytest.mark.parametrize("name", sorted(harness_plans.hand()))
def test_queries_equal_their_oracles(spark, name):
    got = harness_plans.hand()[name](spark, ORDERS)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{ORDERS}/orders.parquet'")
    want = con.sql(harness_plans.hand_oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    found = rows(map(tuple, got.collect()), got.columns)
    assert found == rows(want.fetchall(), want.columns) and found


def clean(spark, text, salt=""):
    return spark.createDataFrame([(text,)], "t string").select(redaction.redact(F.col("t"), salt)).first()[0]


@pytest.mark.parametrize(("text", "pattern"), [('API_KEY = "abcdef123456"', r'API_KEY = "\[REDACTED:assigned-secret#[0-9a-f]{8}\]"'), ("mail a.b@example.com now", r"mail \[REDACTED:email#[0-9a-f]{8}\] now"), ("Bearer abcdefgh12", r"\[REDACTED:bearer-token#[0-9a-f]{8}\]"), ("password: short", "password: short"), ("version 1.2.3", r"version 1\.2\.3"), ("999.1.1.1", r"999\.1\.1\.1"), ("", ""), ("a $1 \\ b x@y.io", r"a \$1 \\ b \[REDACTED:email#[0-9a-f]{8}\]")])
def test_redaction_keeps_what_is_not_secret(spark, text, pattern):
    assert __import__("re").fullmatch(pattern, clean(spark, text))


def test_tags_tell_secrets_apart_and_depend_on_the_salt(spark):
    one, two = clean(spark, "a@x.io b@x.io a@x.io").split()[:2]
    again = clean(spark, "a@x.io b@x.io a@x.io").split()[2]
    assert one == again != two and clean(spark, "a@x.io", "salt") != one
    assert clean(spark, None) is None


def test_corpus_import_drops_contents_and_counts(spark, tmp_path):
    events = sample_plans.sample_events(spark)
    long = events.withColumn("text", F.when(F.col("text") == "All checks passed", F.repeat(F.lit("mail me@x.io and /home/jo/a "), 200)).otherwise(F.col("text"))).cache()
    manifest = {r.session_id: r for r in redaction.import_corpus(long, str(tmp_path), "s").collect()}
    written = spark.read.parquet(f"{tmp_path}/events").collect()
    assert set(manifest) == set(samples.SCRIPTS) and sum(r.events for r in manifest.values()) == len(written) == events.count()
    reads = [r for r in written if r.text and r.text.startswith("[file content: ")]
    assert len(reads) == sum(1 for s in samples.SCRIPTS.values() for t in s if t[0] == "call" and t[1] != "i3" and t[2] == "Read") + 1
    assert manifest["repeats"].dropped == 2 and not any("me@x.io" in (r.text or "") for r in written)
    short = redaction.import_corpus(long, f"{tmp_path}/2", "s", longest=10_000)
    found = {r.session_id: r for r in short.collect()}["repeats"]
    assert found.redactions == 400 and found.sha256 != manifest["repeats"].sha256
    assert not any("/home/jo" in (r.text or "") for r in spark.read.parquet(f"{tmp_path}/2/events").collect())
    assert manifest == {r.session_id: r for r in redaction.import_corpus(long, f"{tmp_path}/3", "s").collect()}


def test_contracts_of_every_kind(spark):
    toml = '[tool.importlinter]\nroot_package = "a"\n[[tool.importlinter.contracts]]\nname = "i"\ntype = "independence"\nmodules = ["a.x", "a.y"]\n[[tool.importlinter.contracts]]\nname = "p"\ntype = "protected"\nprotected_modules = ["a.z"]\nallowed_importers = ["a.x"]\n[[tool.importlinter.contracts]]\nname = "c"\ntype = "acyclic_siblings"\nancestors = ["a"]\n[[tool.importlinter.contracts]]\nname = "l"\ntype = "layers"\nlayers = ["high", "mid | side", "low"]\ncontainers = ["a"]\n'
    cruiser = json.dumps({"forbidden": [{"name": "no-tests", "from": {"path": "^src"}, "to": {"path": "^test"}}]})
    got = {tuple(r) for r in contracts.contracts(spark, {"pyproject.toml": toml, ".dependency-cruiser.json": cruiser}).collect()}
    assert {("i", "independence", "a.x", "a.y", None), ("i", "independence", "a.y", "a.x", None), ("p", "protected", "a.x", "a.z", None), ("c", "acyclic_siblings", "a", None, None), ("no-tests", "path_forbidden", "^src", "^test", None)} <= got
    assert {r[2:] for r in got if r[0] == "l"} == {("a.mid", "a.high", 0), ("a.side", "a.high", 0), ("a.low", "a.high", 0), ("a.low", "a.mid", 1), ("a.low", "a.side", 1)}
    with pytest.raises(ValueError, match="bad.json"):
        contracts.contracts(spark, {"bad.json": "{"})


def test_manifests(spark):
    files = {"requirements-dev.txt": "# tools\npytest>=8  # x\nruff\n-r base.txt\n", "go.mod": "module x\nrequire github.com/a/b v1.2.3\n", "Cargo.toml": '[dependencies]\nserde = "1"\n', "pom.xml": "<dependency><groupId>g</groupId><artifactId>junit</artifactId></dependency>", "app/build.gradle": "implementation 'org.x:lib:1.0'", "package.json": "{", "other.txt": "x"}
    got = {(r.path, r.fact, r.value) for r in contracts.manifest_facts(spark.createDataFrame(list(files.items()), "path string, text string")).collect()}
    assert got == {("requirements-dev.txt", "language", "Python"), ("requirements-dev.txt", "dependency", "pytest"), ("requirements-dev.txt", "dependency", "ruff"), ("go.mod", "language", "Go"), ("go.mod", "dependency", "github.com/a/b"), ("Cargo.toml", "language", "Rust"), ("Cargo.toml", "dependency", "serde"), ("pom.xml", "language", "Java"), ("pom.xml", "dependency", "junit"), ("app/build.gradle", "language", "Java"), ("app/build.gradle", "dependency", "lib"), ("package.json", "unreadable", "package.json")}


def test_report_sinks(spark, tmp_path):
    report = spark.createDataFrame([("b", 2, None), ("a|x", 1, 0.5)], "name string, n int, share double")
    reports.write_json(report, f"{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect()) == ['{"name":"a|x","n":1,"share":0.5}', '{"name":"b","n":2,"share":null}']
    reports.write_markdown(report, f"{tmp_path}/m", ["n"])
    (file,) = (tmp_path / "m").glob("part-*")
    assert file.read_text().splitlines() == ["| name | n | share |", "|---|---:|---:|", r"| a\|x | 1 | 0.5 |", "| b | 2 |  |"]
    bars = spark.createDataFrame([([1, 8, 4, None],), ([3, 3],)], "v array<int>").select(reports.sparkline(F.col("v"))).collect()
    assert [r[0] for r in bars] == ["▁█▄ ", "▁▁"]


def test_results_are_cached_by_content(spark, tmp_path):
    built = []
    table = spark.range(10).withColumn("x", F.col("id") % 3)
    build = lambda df: (built.append(1), df.groupBy("x").count())[1]
    for source in (table, table.repartition(4), table.where("id < 9"), table):
        assert reports.cached(spark, source, "counts", build, str(tmp_path)).count() == 3
    assert len(built) == 2
    reports.cached(spark, table, "counts", build, str(tmp_path), hours=0)
    assert len(built) == 3


@pytest.mark.parametrize("name", sorted(repository_plans.queries()))
def test_repository_queries_equal_their_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    got, want = repository_plans.queries()[name](spark, sf_dir), con.sql(repository_plans.oracle_sql()[name])
    found = rows(map(tuple, got.collect()), got.columns)
    assert found == rows(want.fetchall(), want.columns) and found


def test_tail_and_control_loop_advise_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = samples.build("rereads", samples.SCRIPTS["rereads"])
    told = []

    def decide(events):
        again = events.where("tool_name = 'Read'").groupBy("session_id", "path").count().where("count >= 3")
        return again.select("session_id", F.concat(F.lit("reads:"), "path").alias("signal_id"))

    def turn():
        stream = live.tailed_events(live.tail(spark, f"{tmp_path}/in"))
        live.control_loop(stream, f"{tmp_path}/state", f"{tmp_path}/check", decide, lambda df: told.append(sorted(r.signal_id for r in df.collect()))).awaitTermination()

    for k, part in enumerate((lines[:6], lines[6:12], lines[:12], lines[12:])):
        (tmp_path / "in" / f"{k}.jsonl").write_text("\n".join(part) + "\n\n")
        turn()
    assert told == [[], ["reads:src/parser.py"], [], []]
    assert spark.read.parquet(f"{tmp_path}/state/events").count() == len(lines)


def test_advice_is_delivered_where_the_driver_died_before(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(samples.build("rereads", samples.SCRIPTS["rereads"])) + "\n")
    decide = lambda events: events.select("session_id", F.lit("one").alias("signal_id")).distinct()
    told = []

    def deliver(df, fail):
        if fail:
            raise RuntimeError("no answer")
        told.append([r.signal_id for r in df.collect()])

    def turn(fail):
        stream = live.tailed_events(live.tail(spark, f"{tmp_path}/in"))
        live.control_loop(stream, f"{tmp_path}/state", f"{tmp_path}/check", decide, lambda df: deliver(df, fail)).awaitTermination()

    with pytest.raises(Exception, match="no answer"):
        turn(True)
    turn(False)
    turn(False)
    assert told == [["one"]] and spark.read.parquet(f"{tmp_path}/state/ledger").count() == 1


def test_engine_applies_late_and_repeated_events_once_and_goes_on_after_a_restart(spark, tmp_path):
    from flowgauge.streaming import engine

    events = engine.rows_of(transcripts.records(samples.raw(spark)))
    folder, state = f"{tmp_path}/events", f"{tmp_path}/state"
    engine.redelivered(events, f"{tmp_path}/all", 6)
    files = sorted(p for p in os.listdir(f"{tmp_path}/all") if p.endswith(".parquet"))
    os.makedirs(folder)
    for part in (files[:2], files[2:5], files[5:] + files[:2]):  # each a run of its own, from the checkpoint of the one before
        for k, name in enumerate(part):
            shutil.copy(f"{tmp_path}/all/{name}", f"{folder}/{len(os.listdir(folder))}-{k}-{name}")
        engine.run(spark, folder, state, files=1)
    got = {r.session_id: tuple(r)[1:] for r in engine.reports(spark, state).collect()}
    want = {}
    for r in events.dropDuplicates(["event_id"]).collect():
        want.setdefault(r.session_id, []).append(r)
    for name, rows in want.items():
        used = {}
        for r in rows:
            if r.request_id is not None:
                used.setdefault(r.request_id, r.used)
        calls = [r.call for r in rows if r.call is not None]
        marks = [(r.seq, r.mark) for r in rows if r.mark is not None]
        assert got[name][:2] == (len(rows), len(used)) and got[name][3:] == (len(calls) - len(set(calls)), engine.peak(marks))
        if name != "odd":  # there a request states its usage twice, and differently
            assert got[name][2] == sum(used.values())
    assert set(got) == set(want)


def test_a_silent_session_closes_by_its_timer():
    from flowgauge.streaming import engine

    class Value:
        def __init__(self):
            self.v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

        def iterator(self):
            return iter(self.items())

    class Handle:
        timers = []
        getValueState = lambda self, *a: Value()
        getMapState = lambda self, *a: Map()
        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 1000})()
    e = engine.Engine(idle=50)
    e.init(Handle())
    rows = pd.DataFrame([("x", "a", 1, "Edit {}", "edit", "q", 7), ("x", "a", 1, "Edit {}", "edit", "q", 7), ("x", "b", 3, "Edit {}", "edit", "q", 7), ("x", "c", 2, None, "check", None, 0)], columns=["session_id", "event_id", "seq", "call", "mark", "request_id", "used"])
    (report,) = e.handleInputRows(("x",), iter([rows[:3], rows[3:]]), clock)
    assert report.values.tolist() == [["x", 3, 1, 7, 1, 1, False]] and Handle.timers == [1050]
    (report,) = e.handleExpiredTimer(("x",), clock, None)
    assert report.closed.tolist() == [True] and report.n_events.tolist() == [3]


def test_replay_takes_each_event_once(spark, tmp_path):
    events = sample_plans.sample_events(spark)
    for _ in range(2):
        append_log(events, f"{tmp_path}/log")
    counted = live.replay(spark, f"{tmp_path}/log", lambda e: e.groupBy("session_id").count())
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in events.groupBy("session_id").count().collect()}


def test_registries_refuse_names_that_are_there(spark):
    plan = registry.PLANS["w2_repeated_reads"]
    more = registry.extended(registry.PLANS, [Plan("own_plan", "select 1 as x")])
    assert set(more) - set(registry.PLANS) == {"own_plan"} and "own_plan" not in registry.PLANS
    with pytest.raises(ValueError, match="w2_repeated_reads"):
        registry.extended(registry.PLANS, [plan])
    names = [*registry.PLANS, *sample_plans.queries(), *harness_plans.queries(), *repository_plans.queries(), *(p.name for p in ratio_plans.PLANS)]
    assert len(names) == len(set(names))


def test_bpe_counts(spark):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    texts = ["Some words, and 12 more.", "", None, "日本語 é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", vectorised.bpe_count(path, public_tokenizers.PATTERN)("t").alias("n")).collect()
    assert [r.n for r in got] == [len(plain.encode_ordinary(t or "")) for t in texts]
