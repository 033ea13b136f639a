"""Feeds: tables mapped to the schemas that the operators take.

The operators work on session events, conversation turns, vectors, judged documents, priced turns and documents. These
adapters give each from a plain table; transcripts of coding sessions come from flowgauge.sources.transcripts instead.
Each adapter is one SELECT that any SQL engine can run, so that an oracle shares the definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Events: a user is a session. signup is a prompt, view a read, click an edit, error a failed and purchase a passed check.
EVENTS = """select user_id as session_id, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, ts,
  case event_type when 'signup' then 'prompt' when 'view' then 'read' when 'click' then 'edit' else 'check' end as kind,
  case event_type when 'error' then 'failed' when 'purchase' then 'passed' end as outcome,
  cast(get_json_object(props, '$.k') as bigint) as path, cast(ceil(value) as bigint) as tokens from {events}"""
#: Conversations: user turns are prompts, assistant turns responses.
TURNS = "select conv_id as session_id, turn as seq, role, text from {conversations}"
#: Vectors: a label is a session, ordered by id.
VECTORS = "select label as session_id, vec_id as seq, embedding as vec from {embeddings}"
#: Judged documents: quality is the true label; a document of 1,000 characters or more is predicted to be good.
JUDGED = """select d.doc_id, d.source, d.lang, l.quality as gold, case when d.n_chars >= 1000 then 1 else 0 end as pred,
  round(least(1.0, d.n_chars / 4000.0), 2) as score, d.n_chars as tokens from {documents} d join {labels} l on d.doc_id = l.doc_id"""
#: Priced turns: a customer is a session, an order a turn; hundreds of its price are tokens.
PRICED = """select o_custkey as session_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq,
  o_orderkey as turn_id, cast(o_orderdate as date) as day, cast(floor(o_totalprice / 100) as bigint) as tokens,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'large' else 'small' end as model from {orders}"""
DOCS = "select doc_id, text, lang, source from {documents}"

FEEDS = {"e": EVENTS, "c": TURNS, "v": VECTORS, "j": JUDGED, "t": PRICED, "d": DOCS}
TABLES = {"e": ("events",), "c": ("conversations",), "v": ("embeddings",), "j": ("documents", "labels"), "t": ("orders",), "d": ("documents",)}


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The feed of that name over the tables in a folder."""
    return spark.sql(FEEDS[name], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]})
