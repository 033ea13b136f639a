"""Hook payloads, the event log, reports, prices, annotations and repository evidence on hand-written cases."""

import json

from pyspark.sql import functions as F

from flowgauge.operators import grounding
from flowgauge.sources import records, repository


def test_hook_payloads(spark):
    rows = [
        {"hook_event_name": "UserPromptSubmit", "session_id": "s", "prompt": "go"},
        {"hook_event_name": "PostToolUse", "session_id": "s", "tool_name": "Bash", "tool_use_id": "t", "tool_input": {"command": "ls"}, "tool_response": {"stdout": "a"}},
        {"hook_event_name": "Stop", "session_id": "s"},
        {"hook_event_name": "SessionStart", "session_id": "s"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in rows] + [("broken",)], "value string")
    out = records.hook_events(df).collect()
    assert sorted(r.kind for r in out) == ["intent.stated", "task.completed", "tool.completed", "tool.requested"]
    assert {r.tool_kind for r in out if r.tool_name} == {"exec.shell"}


def test_event_log_round_trip(spark, tmp_path):
    events = spark.createDataFrame([("e1", "s", 1, "response", "assistant", "a\nb"), ("e2", "s", 2, "response", "assistant", None)], "event_id string, session_id string, sequence int, kind string, actor string, text string")
    records.append_log(events, str(tmp_path / "log"))
    records.append_log(events.limit(1), str(tmp_path / "log"))
    (tmp_path / "log/session=x").mkdir()
    (tmp_path / "log/session=x/part.txt").write_text('{"schema": "session.event/9.9", "id": "e3"}\n{"schema": "session.ev')
    out = {r.id: r.text for r in records.read_log(spark, str(tmp_path / "log")).collect()}
    assert out == {"e1": "a\nb", "e2": None}


def test_test_reports_and_verdicts(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<testsuites><testsuite><testcase classname="c" name="a" time="0.5"/><testcase classname="c" name="b" time="1"><failure message="m">x</failure></testcase><testcase classname="c" name="d" time="0"><skipped message="s">why</skipped></testcase></testsuite></testsuites>')
    out = records.test_outcomes(spark, str(tmp_path / "r.xml"))
    assert {r.check_id: r.status for r in out.collect()} == {"c::a": "passed", "c::b": "failed", "c::d": "skipped"}
    assert records.verdict(out).first().verdict == "rejected"
    asked = lambda *names: spark.createDataFrame([(n,) for n in names], "check_id string")
    assert records.verdict(out, asked("c::a")).first().verdict == "accepted"
    assert records.verdict(out, asked("c::a", "c::z")).first().verdict == "incomplete"


def test_prices_as_of(spark, tmp_path):
    book = {"prices": [{"model": "m", "aliases": ["m-latest"], "effective_from": d, "rates": {"input": r, "output": 2 * r, "cache_read": 0.1, "cache_write": 1.0}} for d, r in (("2025-01-01", 1.0), ("2025-06-01", 3.0))]}
    (tmp_path / "p.json").write_text(json.dumps(book))
    prices = records.price_book(spark, str(tmp_path / "p.json"))
    turns = spark.createDataFrame([(1, "m", "2025-03-01", 1_000_000, 0), (2, "m-latest", "2025-06-01", 1_000_000, 1_000_000), (3, "m", "2024-01-01", 5, 5)], "turn_id long, model string, day string, input_tokens long, output_tokens long")
    turns = turns.select("turn_id", "model", F.to_date("day").alias("day"), "input_tokens", "output_tokens", F.lit(0).alias("cache_read_tokens"), F.lit(None).cast("long").alias("cache_write_tokens"))
    assert {r.turn_id: r.dollars for r in records.priced(turns, prices).collect()} == {1: 1.0, 2: 9.0, 3: None}


def test_annotations_are_checked(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "gold_label": "aligned_response"}\n{"id": "2", "gold_label": "nonsense"}\n{"gold_label": "aligned_response"}\n')
    good, bad = records.annotations(spark, str(tmp_path / "a.jsonl"))
    assert good.count() == 1 and bad.count() == 2


FILES = [("src/app/core.py", "import os\nfrom app import util\nclass Core:\n    def run(self): pass\n"), ("src/app/util.py", "def helper(): pass\n"), ("src/app/web/view.py", "from ..core import Core\nfrom . import form\n"), ("src/app/web/form.py", ""), ("tests/test_core.py", "from app.core import Core\n"), ("src/other.py", "x = 1\n"), ("src/bad.py", "def (")]


def test_repository_facts_and_surface(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    found = repository.facts(files)
    assert {(r.path, r.name) for r in found.where("fact = 'symbol'").collect()} == {("src/app/core.py", "Core"), ("src/app/core.py", "run"), ("src/app/util.py", "helper")}
    assert [r.path for r in found.where("fact = 'unparsed'").collect()] == ["src/bad.py"]
    edges = repository.import_edges(found, files)
    assert {tuple(r) for r in edges.collect()} == {("src/app/core.py", "src/app/util.py"), ("src/app/web/view.py", "src/app/core.py"), ("src/app/web/view.py", "src/app/web/form.py"), ("tests/test_core.py", "src/app/core.py")}
    area = grounding.surface(spark.createDataFrame([(1, "src/app/core.py")], "task int, path string"), edges)
    assert {r.path: r.place for r in area.collect()} == {"src/app/core.py": "seed", "src/app/util.py": "neighbour", "src/app/web/view.py": "neighbour", "tests/test_core.py": "test"}
    edits = spark.createDataFrame([(1, 5, "src/app/core.py"), (1, 6, "src/app/web/form.py"), (1, 7, "src/other.py")], "task int, seq int, path string")
    placed = grounding.placed_edits(edits, area, edges)
    assert [r.seq for r in grounding.surface_expansions(placed).collect()] == [6]
    assert [r.seq for r in grounding.unrelated_modifications(placed).collect()] == [7]
    drift = grounding.exploration_drift(edits, area, spark.createDataFrame([(1, 6, 0.9)], "task int, seq int, score double")).collect()
    assert [(r.seq, r.confidence) for r in drift] == [(7, 0.60)]


def test_boundary_violations(spark):
    imports = spark.createDataFrame([(1, "app.web.view", "app.db.sql", False), (2, "app.web.view", "app.database", False), (3, "app.web", "app.db", True)], "seq int, src string, dst string, removed_later boolean")
    contracts = spark.createDataFrame([("no-db", "app.web", "app.db"), ("no-sql", "app.web", "app.db.sql")], "name string, source string, target string")
    assert sorted((r.seq, r.name, r.confidence) for r in grounding.boundary_violations(imports, contracts).collect()) == [(1, "no-sql", 0.9), (3, "no-db", 0.55)]


def test_evidence_use_is_the_first_later_one(spark):
    reads = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (1, 9, "a")], "task int, seq int, path string")
    later = spark.createDataFrame([(1, 1, "a", "early"), (1, 5, "a", "edit"), (1, 4, "a", "check")], "task int, seq int, path string, use string")
    out = {r.seq: (r.first_use, r.use) for r in grounding.evidence_use(reads, later).collect()}
    assert out == {2: (4, "check"), 3: (None, None), 9: (None, None)}
