"""Operators as named plans: each is one query over feeds, which Catalyst plans as a whole."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowgauge.sources.feeds import FEEDS, TABLES, feed

#: What other engines call Spark's functions, for oracles.
RENAMED = (
    (r"\bget_json_object\(", "json_extract_string("),
    (r"\bpercentile\(", "quantile_cont("),
    (r"\bcollect_list\(", "list("),
    (r"\bsha2\((.+?), 256\)", r"sha256(\1)"),
    (r"\barray_intersect\(", "list_intersect("),
    (r"\barray_distinct\(", "list_distinct("),
    (r"\barray_union\((.+?), (.+?)\)", r"list_distinct(list_concat(\1, \2))"),
    (r"\bsize\(", "len("),
    (r"\bregexp_count\((.+?), ('.+?')\)", r"len(regexp_extract_all(\1, \2))"),
    (r"\bcosine\((\w+\.?\w*), (\w+\.?\w*)\)", r"list_cosine_similarity(cast(\1 as double[]), cast(\2 as double[]))"),
    (r"\bunix_micros\(", "epoch_us("),
    (r"\bexplode\(", "unnest("),
    (r"\brlike ('.+?')", r"similar to '(?s).*(?:' || \1 || ').*'"),
    (r"\bbround\(", "round_even("),
    (r"\barray_join\(", "array_to_string("),
    (r"\bsequence\(", "generate_series("),
    (r"\btransform\(", "list_transform("),
    (r"(?<! )\bfilter\((?!where)", "list_filter("),
    (r"\barray_except\((.+?), (.+?)\)", r"list_filter(\1, x -> not list_contains(\2, x))"),
    (r"\bregexp_replace\(((?:[^()']|\([^()]*\))+), ('[^']*'), ('[^']*')\)", r"regexp_replace(\1, \2, \3, 'g')"),
    (r"\b(\w+) -> ", r"lambda \1: "),
)
#: Cosine in Spark's own functions.
COSINE = "(aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (a, x) -> a + x) / sqrt(aggregate({0}, cast(0 as double), (a, x) -> a + cast(x as double) * cast(x as double)) * aggregate({1}, cast(0 as double), (a, x) -> a + cast(x as double) * cast(x as double))))"


#: A number with a point: double in every engine, not decimal.
POINT = r"(?<![\w'.])(\d+\.\d+)(?![\w'.])"


@dataclass(frozen=True)
class Plan:
    """A query over the feeds it names in braces. duck holds an oracle's text where renaming functions isn't enough; then
    is an operator that the query's rows go through, which the oracle's text holds too."""

    name: str
    sql: str
    duck: str | None = None
    then: Callable[[DataFrame], DataFrame] | None = None

    @property
    def feeds(self) -> list[str]:
        return sorted(set(re.findall(r"\{(\w)\}", self.sql)))

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The result over frames given for the feeds, whatever they come from."""
        text = re.sub(r"\bcosine\((\w+\.?\w*), (\w+\.?\w*)\)", lambda m: COSINE.format(m[1], m[2]), self.sql)
        text = re.sub(POINT, r"\1D", text)
        # only the feeds' own braces are places to fill
        text = re.sub(r"\{(?!\w\})", "{{", re.sub(r"(?<!\{\w)\}", "}}", text))
        out = spark.sql(text, **frames)
        return self.then(out) if self.then else out

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.apply(spark, **{f: feed(spark, sf_dir, f) for f in self.feeds})

    @property
    def oracle(self) -> str:
        """Text for an engine that has the tables as views."""
        body = (self.duck or self.sql).strip()
        for old, new in RENAMED if self.duck is None else ():
            body = re.sub(old, new, body)
        body = re.sub(r"\{(\w)\}", r"feed_\1", re.sub(POINT, r"(\1)::double", body))
        feeds = []
        for f in sorted(set(re.findall(r"\{(\w)\}", self.duck or self.sql))):
            text = FEEDS[f]
            for t in TABLES[f]:
                text = text.replace(f"{{{t}}}", t)
            feeds.append(f"feed_{f} as ({text.replace('get_json_object(', 'json_extract_string(')})")
        word = "with recursive " if body.startswith("with recursive") else "with "
        rest = re.sub(r"^with (recursive )?", ", ", body) if body.startswith("with ") else " " + body
        return word + ", ".join(feeds) + rest
