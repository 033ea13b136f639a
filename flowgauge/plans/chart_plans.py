"""Charts of sessions' measures in process order, with limits, zones and runs; the oracle runs one window a measure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgauge.operators import charts
from flowgauge.sources.feeds import EVENTS, feed

#: A session's measures, in the order in which sessions begin; tokens have no upper bound, a share has both.
MEASURES = """with s as (select session_id, min(ts) as began, sum(case when outcome = 'failed' then tokens else 0 end) * 1.0 / nullif(sum(tokens), 0) as failed, count(case when kind = 'edit' then 1 end) * 1.0 / count(*) as edits, sum(tokens) * 1.0 as tokens,
  count(case when outcome = 'passed' then 1 end) * 1.0 / nullif(count(case when kind = 'check' then 1 end), 0) as passed from {e} group by session_id)
select 'failed_share' as measure, session_id, began, cast(failed as double) as value, 0.0 as low, 1.0 as high from s union all select 'edit_share', session_id, began, cast(edits as double), 0.0, 1.0 from s
union all select 'tokens', session_id, began, cast(tokens as double), 0.0, null from s union all select 'passed_share', session_id, began, cast(passed as double), 0.0, 1.0 from s"""


def w42_charts_of_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.sql(MEASURES, e=feed(spark, sf_dir, "e"))
    return charts.signals(values, ["began", "session_id"]).select("measure", "session_id", "place", F.round("value", 6).alias("value"), "rule", "side")


_ZONE = "select *, '{rule}' as rule, '{side}' as side from d where place + 1 >= {n} and sigma > 0 and {limit} is not null and {sign} * z > {k} + 1e-9 and (select count(*) from d b where b.measure = d.measure and b.place between d.place - {n} + 1 and d.place and {sign} * b.z > {k} + 1e-9) >= {least}"
_RUN = "select *, 'run_of_eight' as rule, '{side}' as side from d where place >= 7 and {limit} is not null and (select min({sign} * (b.value - b.centre)) from d b where b.measure = d.measure and b.place between d.place - 7 and d.place) > 1e-9"
_SIDES = ({"side": "above", "sign": "1", "limit": "ucl"}, {"side": "below", "sign": "-1", "limit": "lcl"})
_RULES = [f"select *, 'beyond_limits' as rule, '{s['side']}' as side from d where {s['sign']} * (value - {s['limit']}) > 1e-9" for s in _SIDES]
_RULES += [_ZONE.format(rule=r, n=n, k=k, least=m, **s) for s in _SIDES for r, n, k, m in (("two_of_three", 3, 2, 2), ("four_of_five", 5, 1, 4))] + [_RUN.format(**s) for s in _SIDES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"w42_charts_of_sessions": w42_charts_of_sessions}


def oracle_sql() -> dict[str, str]:
    events = EVENTS.replace("{events}", "events").replace("get_json_object(", "json_extract_string(")
    return {
        "w42_charts_of_sessions": f"""with e as ({events}), v as ({MEASURES.replace("{e}", "e")}), p as (select *, row_number() over (partition by measure order by began, session_id) - 1 as place from v where value is not null),
m as (select *, abs(value - lag(value) over (partition by measure order by place)) as moved from p), l as (select measure, avg(value) as centre, avg(moved) as mr, max(low) as low, max(high) as high from m group by measure having count(*) >= 8),
d as (select p.*, l.centre, l.mr / 1.128 as sigma, (p.value - l.centre) / nullif(l.mr / 1.128, 0) as z, if(l.high is null or l.centre + 2.66 * l.mr <= l.high, l.centre + 2.66 * l.mr, null) as ucl, if(l.centre - 2.66 * l.mr >= l.low, l.centre - 2.66 * l.mr, null) as lcl from p join l on l.measure = p.measure)
select measure, session_id, place, round(value, 6) as value, rule, side from ({" union all ".join(_RULES)})"""
    }
