"""Queries over a small repository and over routing runs, both written by hand: import graphs, change surfaces, contracts,
drift, routes. Oracles have the facts as literals and state the rules in SQL. Those that read no given table are for tests
(hand()); flowgauge.plans.repository_plans runs the same operators over repositories derived from events."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators import grounding
from flowgauge.sources import contracts, repository, reports, routing_runs
from flowgauge.sources.feeds import feed

FILES = {
    "shop/cart.py": "from shop import prices\nimport shop.tax\n\n\nclass Cart:\n    pass\n",
    "shop/prices.py": "VALUE = 1\n",
    "shop/tax.py": "from . import prices\n\n\ndef rate():\n    return prices.VALUE\n",
    "web/views.py": "from shop.cart import Cart\nfrom shop import prices\n",
    "web/forms.py": "import web.views\n",
    "tests/test_cart.py": "import shop.cart\n",
    "tools/gen.py": "import os\n",
    "tools/broken.py": "def f(:\n",
    "pyproject.toml": '[project]\nname = "shop"\ndependencies = ["requests>=2", "rich"]\n',
    "web/package.json": '{"dependencies": {"vue": "3"}, "devDependencies": {"vite": "5"}}',
}
#: What the import graph of FILES is, read off by eye.
EDGES = [("shop/cart.py", "shop/prices.py"), ("shop/cart.py", "shop/tax.py"), ("shop/tax.py", "shop/prices.py"), ("web/views.py", "shop/cart.py"), ("web/views.py", "shop/prices.py"), ("web/forms.py", "web/views.py"), ("tests/test_cart.py", "shop/cart.py")]
SEEDS = [(1, "shop/tax.py"), (2, "shop/cart.py"), (3, "tools/gen.py")]
EDITS = [(1, 5, "shop/tax.py"), (1, 6, "shop/cart.py"), (1, 7, "web/views.py"), (1, 8, "tools/gen.py"), (1, 9, "tests/test_cart.py"), (2, 3, "web/forms.py"), (2, 4, "tests/test_cart.py"), (2, 5, "tests/test_other.py"), (3, 2, "shop/prices.py")]
READS = [(1, 1, "shop/prices.py"), (1, 2, "web/forms.py"), (1, 3, "tools/gen.py"), (2, 1, "tools/gen.py"), (3, 1, "tools/gen.py")]
ALIGNED = [(1, 2, 0.2), (1, 3, 0.9), (2, 1, 0.4)]
LINTER = "[importlinter]\nroot_package = shop\n[importlinter:contract:1]\nname = no web in shop\ntype = forbidden\nsource_modules =\n    shop\nforbidden_modules =\n    web\n[importlinter:contract:2]\nname = layers\ntype = layers\nlayers =\n    web\n    shop.cart\n    shop.prices\n"
IMPORTS = [(1, "shop.prices", "web.views", False), (2, "shop.cart", "shop.prices", False), (3, "shop.prices", "shop.cart", True), (4, "web.views", "shop.cart", False)]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FILES.items()), "path string, text string")


def _edges(spark: SparkSession) -> DataFrame:
    return repository.import_edges(repository.facts(_files(spark)), _files(spark))


def _area(spark: SparkSession) -> DataFrame:
    return grounding.surface(spark.createDataFrame(SEEDS, "task long, path string"), _edges(spark))


def _placed(spark: SparkSession) -> DataFrame:
    return grounding.placed_edits(spark.createDataFrame(EDITS, "task long, seq long, path string"), _area(spark), _edges(spark))


def s23_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.facts(_files(spark)).where("fact <> 'import'").select("path", "fact", "name", "kind")


def g9_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark)


def g9_change_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _area(spark)


def d18_unrelated_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.unrelated_modifications(_placed(spark)).select("task", "seq", "path", "confidence")


def d19_surface_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.surface_expansions(_placed(spark)).select("task", "seq", "path", "confidence")


def s24_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.contracts(spark, {"setup.cfg": LINTER})


def d20_boundary_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = spark.createDataFrame(IMPORTS, "seq long, src string, dst string, removed_later boolean")
    return grounding.boundary_violations(imports, s24_contracts(spark, sf_dir)).select("seq", "src", "dst", "name", "confidence")


def d21_exploration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = spark.createDataFrame(READS, "task long, seq long, path string")
    return grounding.exploration_drift(reads, _area(spark), spark.createDataFrame(ALIGNED, "task long, seq long, score double")).select("task", "seq", "path", "confidence")


def p47_manifest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.manifest_facts(_files(spark))


USAGE = [
    ("run", "t1", "north", "m-small", 100, 10, 900, 0, "2026-01-05T09:00:10Z"), ("run", "t1", "south", "m-small", 100, 40, 800, 1, "2026-01-05T09:00:30Z"),
    ("run", "t2", "north", "m-small", 50, 5, 700, 0, "2026-01-05T09:01:10Z"), ("run", "t2", "north", "m-large", 50, 9, 700, 0, "2026-01-05T09:01:30Z"),
    ("run", "t3", "north", "m-small", 80, 8, 700, 0, "2026-01-05T09:02:10Z"), ("run", "t3", "north", "m-large", 80, 30, 700, 1, "2026-01-05T09:02:30Z"),
    ("run", "t4", "north", "m-small", 10, 1, 100, 0, "2026-01-05T09:03:00Z"), ("run", "t4", "east", "m-small", 10, 1, 100, 0, "2026-01-05T09:03:10Z"),
]
USAGE_NAMES = ("run_id", "task_id", "provider", "model", "input_tokens", "output_tokens", "latency_ms", "success", "created_at")
EXPLAIN = {"run": {"id": "run", "goal": "Write the report", "status": "done", "created_at": "2026-01-05T09:00:00Z"}, "tasks": [{"id": t, "title": f"Part {t}", "role": "writer", "status": s, "error": e, "finished_at": at} for t, s, e, at in (("t1", "done", None, "2026-01-05T09:00:40Z"), ("t2", "failed", "no answer", "2026-01-05T09:01:40Z"), ("t3", "done", None, "2026-01-05T09:02:40Z"), ("t4", "failed", "gone", "2026-01-05T09:03:20Z"))]}


def _run(spark: SparkSession) -> DataFrame:
    usage = spark.createDataFrame([(json.dumps(dict(zip(USAGE_NAMES, r))),) for r in USAGE] + [("not json",)], "value string")
    return routing_runs.events(usage, spark.createDataFrame([(json.dumps(EXPLAIN),)], "value string"))


def s13_routing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark).select("session_id", "sequence", "kind", "task_id", "text", "model", "input_tokens")


def d16_failed_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_runs.failed_routes(_run(spark))


def d17_unearned_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing_runs.unearned_escalations(_run(spark))


def p48_sparklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each session's turns as bars, and their sum as a duration."""
    turns = feed(spark, sf_dir, "t").groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tokens"))), lambda x: x["tokens"]).alias("v"), F.sum("tokens").alias("n"))
    return turns.select("session_id", reports.sparkline(F.col("v")).alias("bars"), reports.duration(F.col("n")).alias("lasted"))


GRAPH = f"{_values('edges', 'src, dst', EDGES)}, {_values('seeds', 'task, path', SEEDS)}, {_values('edits', 'task, seq, path', EDITS)}, near as (select src as a, dst as b from edges union select dst, src from edges)"
SURFACE = f"""{GRAPH}, one as (select distinct s.task, n.b as path from seeds s join near n on n.a = s.path where n.b not like 'tests/%' and not exists (select 1 from seeds o where o.task = s.task and o.path = n.b)),
core as (select task, path, 'seed' as place from seeds union all select task, path, 'neighbour' from one), area as (select * from core union all select distinct c.task, n.b, 'test' from core c join near n on n.a = c.path where n.b like 'tests/%')"""
ROUTES = f"""{_values('u', ', '.join(USAGE_NAMES), USAGE)}, {_values('tasks', 'task_id, title, status, error, finished_at', [(t['id'], t['title'], t['status'], t['error'], t['finished_at']) for t in EXPLAIN['tasks']])},
b as (select u.*, (select arg_max([cast(o.success as varchar), o.provider, o.model], o.created_at) from u o where o.task_id = u.task_id and o.created_at < u.created_at) as old from u),
x as (select '2026-01-05T09:00:00Z' as moment, 0 as r, 'intent.stated' as kind, null as task_id, 'Write the report' as text, null as model, null as input_tokens
union all select created_at, 1, if(old[2] <> provider, 'route.failover', 'route.escalated'), task_id, old[2] || ' -> ' || provider, model, null from b where old[1] = '0' and (old[2] <> provider or old[3] <> model)
union all select created_at, 2, if(success = 1, 'response', 'attempt.failed'), task_id, provider, model, input_tokens from u
union all select finished_at, 3, if(status = 'failed', 'task.failed', 'task.completed'), task_id, coalesce(error, title), null, null from tasks),
ev as (select 'run' as session_id, row_number() over (order by moment, r) as sequence, kind, task_id, text, model, cast(input_tokens as bigint) as input_tokens from x)"""
BARS = """with v as (select o_custkey as session_id, cast(floor(o_totalprice / 100) as bigint) as t, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders), m as (select session_id, min(t) as lo, max(t) as hi, sum(t) as s from v group by session_id),
p as (select v.session_id, n, case when hi = lo then 1 else cast(floor((t - lo) / (hi - lo) * 7 + 0.5) as int) + 1 end as k, s from v join m on m.session_id = v.session_id)
select session_id, string_agg(substr('▁▂▃▄▅▆▇█', k, 1), '' order by n) as bars, case when any_value(s) < 60 then any_value(s) || 's' when any_value(s) < 3600 then (any_value(s) // 60) || 'm ' || (any_value(s) % 60) || 's' else (any_value(s) // 3600) || 'h ' || (any_value(s) % 3600 // 60) || 'm' end as lasted from p group by session_id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p48_sparklines": p48_sparklines}


def oracle_sql() -> dict[str, str]:
    return {"p48_sparklines": BARS}


def hand() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All of this module, by name."""
    found = (s23_symbols, g9_import_edges, g9_change_surface, d18_unrelated_modification, d19_surface_expansion, s24_contracts, d20_boundary_violation, d21_exploration_drift, p47_manifest_facts, s13_routing_run, d16_failed_route, d17_unearned_escalation, p48_sparklines)
    return {f.__name__: f for f in found}


def hand_oracle_sql() -> dict[str, str]:
    return {
        "s23_symbols": "with " + _values("f", "path, fact, name, kind", [("shop/cart.py", "symbol", "Cart", "class"), ("shop/tax.py", "symbol", "rate", "function"), ("tools/broken.py", "unparsed", None, None)]) + " select * from f",
        "g9_import_edges": f"with {_values('edges', 'src, dst', EDGES)} select * from edges",
        "g9_change_surface": f"with {SURFACE} select cast(task as bigint) as task, path, place from area",
        "d18_unrelated_modification": f"with {SURFACE} select cast(e.task as bigint) as task, cast(e.seq as bigint) as seq, e.path, if(contains(e.path, 'test'), 0.55, 0.60)::double as confidence from edits e where not exists (select 1 from area a where a.task = e.task and (a.path = e.path or exists (select 1 from near n where n.a = a.path and n.b = e.path)))",
        "d19_surface_expansion": f"with {SURFACE} select cast(e.task as bigint) as task, cast(e.seq as bigint) as seq, e.path, 0.6::double as confidence from edits e where not exists (select 1 from area a where a.task = e.task and a.path = e.path) and exists (select 1 from area a join near n on n.a = a.path where a.task = e.task and n.b = e.path)",
        "s24_contracts": "with " + _values("c", "name, kind, source, target, place", [("no web in shop", "forbidden", "shop", "web", None), ("layers", "layers", "shop.cart", "web", 0), ("layers", "layers", "shop.prices", "web", 0), ("layers", "layers", "shop.prices", "shop.cart", 1)]) + " select * from c",
        "d20_boundary_violation": "with " + _values("c", "name, source, target", [("no web in shop", "shop", "web"), ("layers", "shop.cart", "web"), ("layers", "shop.prices", "web"), ("layers", "shop.prices", "shop.cart")]) + ", " + _values("i", "seq, src, dst, gone", IMPORTS) + ", h as (select i.*, c.name, c.target from i join c on (i.src = c.source or starts_with(i.src, c.source || '.')) and (i.dst = c.target or starts_with(i.dst, c.target || '.'))) select cast(seq as bigint) as seq, src, dst, min(name) as name, if(any_value(gone), 0.55, 0.90)::double as confidence from h where length(target) = (select max(length(o.target)) from h o where o.seq = h.seq) group by seq, src, dst",
        "d21_exploration_drift": f"with {SURFACE}, {_values('reads', 'task, seq, path', READS)}, {_values('al', 'task, seq, score', ALIGNED)} select cast(r.task as bigint) as task, cast(r.seq as bigint) as seq, r.path, if(exists (select 1 from area a where a.task = r.task and string_split(a.path, '/')[1] = string_split(r.path, '/')[1]), 0.60, 0.75)::double as confidence from reads r left join al on al.task = r.task and al.seq = r.seq where coalesce(al.score, 0) < 0.5 and not exists (select 1 from area a where a.task = r.task and a.path = r.path)",
        "p47_manifest_facts": "with " + _values("f", "path, fact, value", [("pyproject.toml", "language", "Python"), ("pyproject.toml", "dependency", "requests"), ("pyproject.toml", "dependency", "rich"), ("web/package.json", "language", "JavaScript"), ("web/package.json", "dependency", "vue"), ("web/package.json", "dependency", "vite")]) + " select * from f",
        "s13_routing_run": f"with {ROUTES} select * from ev",
        "d16_failed_route": f"with {ROUTES} select session_id, sequence, task_id, if(exists (select 1 from ev o where o.task_id = ev.task_id and o.kind = 'response' and o.sequence > ev.sequence), 0.8, 0.55)::double as confidence from ev where kind = 'route.failover'",
        "d17_unearned_escalation": f"with {ROUTES}, n as (select ev.*, (select arg_min(o.kind, o.sequence) from ev o where o.task_id = ev.task_id and o.sequence > ev.sequence) as following from ev) select session_id, sequence, task_id, if(following = 'attempt.failed', 0.8, 0.6)::double as confidence from n where kind = 'route.escalated' and following is distinct from 'response'",
        "p48_sparklines": BARS,
    }
