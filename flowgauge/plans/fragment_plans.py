"""Queries over the fragment store: documents are prompts and their lines spans, loaded in two halves; users hold versions of
the files that events edit. Oracles need no store: they state the rules over the tables at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge import shared
from flowgauge.operators import fragments

#: Lines of documents: load 0 has those of even ids, load 1 the others. Tokens are a quarter of the line's characters.
SPANS = "select doc_id as owner, place, line as text, greatest(1, cast(floor(length(line) / 4) as bigint)) as tokens, cast(abs(doc_id) % 2 as int) as load from (select doc_id, posexplode(split(text, '\\n')) as (place, line) from {d} where text is not null)"


def _loaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """All fragments of documents, and the folder of a store into which both loads have been put."""
    folder = f"{shared.checkpoints(spark)}/fragments-{uuid.uuid4().hex}"
    spans = spark.sql(SPANS, d=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for load in (0, 1):
        fragments.put(fragments.shard(spans.where(F.col("load") == load)), folder, load)
    return fragments.shard(spans), folder


def k1_fragment_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, folder = _loaded(spark, sf_dir)
    return fragments.stored(spark, folder).select("id", "tokens", F.col("owner").alias("origin"), "load")


def k5_delta_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_, folder = _loaded(spark, sf_dir)
    found = fragments.delta(all_, fragments.stored(spark, folder), 0)
    return found.select(F.col("owner").alias("doc_id"), "hits", "misses", "total_tokens", "sent_tokens", "saved_tokens", "compression", F.sha2("text", 256).alias("resolved_sha256"))


FILES = "select user_id as owner, cast(get_json_object(props, '$.k') as bigint) as fragment, ts as at, event_id, event_type = 'click' as update from {e} where event_type in ('view', 'click')"


def k6_skews_of_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments.skews(fragments.versions(spark.sql(FILES, e=spark.read.parquet(f"{sf_dir}/events.parquet"))))


_LINES = r"""l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents where text is not null),
f as (select doc_id, place, abs(doc_id) % 2 as load, greatest(1, length(line) // 4) as tokens, trim(regexp_replace(nfc_normalize(line), '[\t-\r\x1c-\x1f\x{85}\pZ]+', ' ', 'g')) as text from l),
g as (select *, sha256(text) as id from f where text <> ''), one as (select id, arg_min(struct_pack(tokens := tokens, origin := doc_id, load := load), (load, doc_id, place)) as s from g group by id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (k1_fragment_store, k5_delta_prompts, k6_skews_of_versions)}


def oracle_sql() -> dict[str, str]:
    return {
        "k1_fragment_store": f"with {_LINES} select id, cast(s.tokens as bigint) as tokens, s.origin as origin, cast(s.load as integer) as load from one",
        "k5_delta_prompts": f"""with {_LINES}, m as (select g.doc_id, g.place, g.text, one.s.tokens as n, exists (select 1 from g o where o.id = g.id and o.load = 0) as hit from g join one on one.id = g.id)
select doc_id, count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, cast(sum(n) as bigint) as total_tokens, cast(coalesce(sum(n) filter (where not hit), 0) as bigint) as sent_tokens, cast(coalesce(sum(n) filter (where hit), 0) as bigint) as saved_tokens,
  round(coalesce(sum(n) filter (where hit), 0) / sum(n), 6) as compression, sha256(string_agg(text, chr(10) order by place)) as resolved_sha256 from m group by doc_id""",
        "k6_skews_of_versions": """with f as (select user_id as owner, cast(json_extract_string(props, '$.k') as bigint) as fragment, ts, event_id, event_type from events where event_type in ('view', 'click')),
n as (select *, count(*) filter (where event_type = 'click') over (partition by fragment order by ts, event_id) as version from f where fragment is not null), h as (select owner, fragment, max(version) as version from n group by owner, fragment),
s as (select fragment, count(*) as owners, max(version) - min(version) as gap, max(version) as latest, count(*) filter (where version < (select max(x.version) from h x where x.fragment = h.fragment)) as stale from h group by fragment)
select fragment, owners, gap, if(gap > 2 or owners > 4, 'HIGH', if(owners >= 3, 'MEDIUM', 'LOW')) as severity, latest, stale from s where owners >= 2 and gap > 0""",
    }
