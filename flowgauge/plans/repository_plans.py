"""Import graphs, change surfaces, contracts and drift over repositories that Spark derives from events.

A user has a file in each of the packages m0 to m8 that the keys of its views and clicks name; two views one after the other
are an import, and a sign-up is a test of a file. A user is a task: the first click names its seed, all clicks are edits
(some of tests, some in another user's files), and views are reads. The oracles state edges and facts from events directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators import grounding
from flowgauge.sources import contracts, repository
from flowgauge.sources.feeds import feed

#: A contract file: one forbidden import and three layers.
LINTER = "[importlinter]\nroot_package = m1\n[importlinter:contract:1]\nname = no m2 in m1\ntype = forbidden\nsource_modules =\n    m1\nforbidden_modules =\n    m2\n[importlinter:contract:2]\nname = layers\ntype = layers\nlayers =\n    m3\n    m4\n    m5\n"
#: Events by the files that they mean, in SQL that any engine can run; {e} is the events' feed or its like.
ACTS = "a as (select session_id as task, event_id as seq, kind, path as k, path % 9 as j, tokens from {e})"
PARTS = f"""{ACTS},
v as (select *, lag(j) over (partition by task order by seq) as before from a where kind = 'read'),
i as (select task, before as src, j as dst, min(seq) as seq from v where before <> j group by task, before, j),
m as (select distinct task, j from a where kind in ('read', 'edit')),
u as (select distinct task, j from a where kind = 'prompt')"""
FILE, TEST = "concat('m', {0}, '/u', {1}, '.py')", "concat('tests/test_m', {0}, '_u', {1}, '.py')"
EDITS = f"select task, seq, case when k % 7 = 0 then {TEST.format('j', 'task')} when k % 5 = 1 then {FILE.format('j', 'task + 1')} else {FILE.format('j', 'task')} end as path from a where kind = 'edit'"
SEEDS = f"select task, {FILE.format('j', 'task')} as path from (select *, row_number() over (partition by task order by seq) as n from a where kind = 'edit') x where n = 1"
READS = f"select task, seq, case when k % 4 = 0 then concat('tools/gen', j, '.py') else {FILE.format('j', 'task')} end as path from a where kind = 'read'"
ALIGNED = "select task, seq, (tokens % 10) / 10.0 as score from a where kind = 'read' and seq % 3 <> 0"
IMPORTS = "select seq, concat('m', src, '.u', task) as src, concat('m', dst, '.u', task) as dst, seq % 4 = 0 as removed_later from i"


def _rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(f"with {PARTS} {text}", e=feed(spark, sf_dir, "e"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text of every file."""
    return _rows(
        spark,
        sf_dir,
        f"""select {FILE.format("m.j", "m.task")} as path, concat(coalesce(max(x.head), ''), 'class C', m.j, ':', chr(10), '    pass', chr(10), 'def f', m.j, '():', chr(10), '    return ', m.j, chr(10)) as text
from m left join (select task, src, concat(array_join(array_sort(collect_list(concat('import m', dst, '.u', task))), chr(10)), chr(10)) as head from i group by task, src) x on x.task = m.task and x.src = m.j group by m.j, m.task
union all select {TEST.format("j", "task")}, concat('import m', j, '.u', task, chr(10)) from u
union all select distinct concat('m', j, '/broken', task, '.py'), concat('def f(:', chr(10)) from a where kind = 'check' and k > 90""",
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files(spark, sf_dir)
    return repository.import_edges(repository.facts(found), found)


def _area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.surface(_rows(spark, sf_dir, SEEDS), edges(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.placed_edits(_rows(spark, sf_dir, EDITS), _area(spark, sf_dir), edges(spark, sf_dir))


def s23_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repository.facts(files(spark, sf_dir)).where("fact <> 'import'").select("path", "fact", "name", "kind")


def g9_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def g9_change_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _area(spark, sf_dir)


def d18_unrelated_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.unrelated_modifications(_placed(spark, sf_dir)).select("task", "seq", "path", "confidence")


def d19_surface_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.surface_expansions(_placed(spark, sf_dir)).select("task", "seq", "path", "confidence")


def d20_boundary_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = contracts.contracts(spark, {"setup.cfg": LINTER})
    return grounding.boundary_violations(_rows(spark, sf_dir, IMPORTS), rules).select("seq", "src", "dst", "name", "confidence")


def d21_exploration_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.exploration_drift(_rows(spark, sf_dir, READS), _area(spark, sf_dir), _rows(spark, sf_dir, ALIGNED)).select("task", "seq", "path", F.col("confidence").cast("double").alias("confidence"))


_FEED = "select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, case event_type when 'signup' then 'prompt' when 'view' then 'read' when 'click' then 'edit' else 'check' end as kind, cast(json_extract_string(props, '$.k') as bigint) as path, cast(ceil(value) as bigint) as tokens from events"
FACTS = f"with f0 as ({_FEED}), {PARTS.replace('{e}', 'f0')}"
GRAPH = f"""{FACTS}, edges as (select {FILE.format("src", "task")} as src, {FILE.format("dst", "task")} as dst from i union select {TEST.format("u.j", "u.task")}, {FILE.format("u.j", "u.task")} from u where exists (select 1 from m where m.task = u.task and m.j = u.j)),
near as (select src as x, dst as y from edges union select dst, src from edges), seeds as ({SEEDS}), edits as ({EDITS}), reads as ({READS}), al as ({ALIGNED})"""
SURFACE = f"""{GRAPH}, one as (select distinct s.task, n.y as path from seeds s join near n on n.x = s.path where n.y not like 'tests/%' and n.y <> s.path),
core as (select task, path, 'seed' as place from seeds union all select task, path, 'neighbour' from one), area as (select * from core union all select distinct c.task, n.y, 'test' from core c join near n on n.x = c.path where n.y like 'tests/%')"""
HOME = "list_contains((select list(distinct string_split(path, '/')[1]) from area where area.task = r.task), string_split(r.path, '/')[1])"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (s23_symbols, g9_import_edges, g9_change_surface, d18_unrelated_modification, d19_surface_expansion, d20_boundary_violation, d21_exploration_drift)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    linked = "exists (select 1 from area join near n on n.x = area.path where area.task = e.task and n.y = e.path)"
    on = "exists (select 1 from area where area.task = e.task and area.path = e.path)"
    return {
        "s23_symbols": f"{FACTS} select {FILE.format('j', 'task')} as path, 'symbol' as fact, 'C' || j as name, 'class' as kind from m union all select {FILE.format('j', 'task')}, 'symbol', 'f' || j, 'function' from m union all select distinct concat('m', j, '/broken', task, '.py'), 'unparsed', null, null from a where kind = 'check' and k > 90",
        "g9_import_edges": f"{GRAPH} select * from edges",
        "g9_change_surface": f"{SURFACE} select task, path, place from area",
        "d18_unrelated_modification": f"{SURFACE} select task, seq, path, if(path like 'tests/%', 0.55, 0.6)::double as confidence from edits e where not {on} and not {linked}",
        "d19_surface_expansion": f"{SURFACE} select task, seq, path, 0.6::double as confidence from edits e where not {on} and {linked}",
        "d20_boundary_violation": f"{FACTS}, x as ({IMPORTS}), c(source, target, name) as (values ('m1', 'm2', 'no m2 in m1'), ('m4', 'm3', 'layers'), ('m5', 'm3', 'layers'), ('m5', 'm4', 'layers')) select x.seq, x.src, x.dst, c.name, if(removed_later, 0.55, 0.9)::double as confidence from x join c on c.source = string_split(x.src, '.')[1] and c.target = string_split(x.dst, '.')[1]",
        "d21_exploration_drift": f"{SURFACE} select r.task, r.seq, r.path, if({HOME}, 0.6, 0.75)::double as confidence from reads r left join al on al.task = r.task and al.seq = r.seq where coalesce(al.score, 0) < 0.5 and not exists (select 1 from area where area.task = r.task and area.path = r.path)",
    }
