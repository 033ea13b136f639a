"""Secret scans with DataFrame functions only: base patterns, and two character Markov models for what they miss.

The models, of random strings and of ordinary identifiers, are counts of character pairs in labelled samples, smoothed
by one. A long token is a secret where the log-likelihood ratio per character pair passes a threshold, which other
samples of the same kinds set. Of a token that does not pass as a whole, the runs that do are secrets, each with what is
left of the parts that it touches. Matches are placed by splitting the text at them: the lengths of pieces and matches
add up to positions. A token is cut into its characters once, and all sums and folds run in two levels (runs of RUN
elements, and these), so that neither a very long token nor very many matches take n^2 steps.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDE = len(ALPHABET) + 1
#: Tokens the models judge.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Least characters of a random run inside a token, the excess over the threshold that it must gather, and how far this
#: may fall before the run ends.
LEAST_RUN, EVIDENCE, DROP = 16, 8.0, 6.0
#: The bound of the labelled sample: random strings made by rule, and words of ordinary text. Every CHECK_EVERY-th is kept
#: from the counts and sets the threshold, where a false alarm weighs as much as ALARM missed secrets.
RANDOM_ROWS, WORD_ROWS, CHECK_EVERY, ALARM = 4000, 20_000, 4, 10
#: Elements that sums and folds take at once, and characters that a token is cut into at once.
RUN, PIECE = 256, 4096
KINDS = ("assign", "access", "hex", "markov")
#: The base patterns (of a match of the first, group 2 must have 8 characters; a match of the others is as
#: long as it can be, so that the least length may stand in the pattern).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MASK = "[secret]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(numbers: Column, first: Column) -> Column:
    return F.aggregate(numbers, first, lambda a, x: a + x)


def _running(numbers: Column, first: Column) -> Column:
    """first and each sum of it and the leading numbers: one element more than there are numbers."""
    return F.aggregate(numbers, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def in_runs(elements: Column, run: int = RUN) -> Column:
    """The elements in arrays of at most run; elements isn't empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(elements) - 1) / run).cast("int")), lambda k: F.slice(elements, k * run + 1, run))


def starts(lengths: Column) -> Column:
    """The sum of all elements before each one; lengths isn't empty."""
    parts = lambda r: let(_running(F.transform(r, lambda x: _sum(x, F.lit(0))), F.lit(0)), lambda base: F.flatten(F.transform(r, lambda x, k: F.slice(_running(x, base[k]), 1, F.size(x)))))
    return let(in_runs(lengths), parts)


def fold(elements: Column, begin: Column, put: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A struct of the last state (s) and all that was put out (out), an array of the type put. step takes a state and an
    element and gives the next state and an array to put out; elements isn't empty."""
    none = F.expr(f"cast(array() as array<{put}>)")

    def one(a: Column, x: Column) -> Column:
        state, new = step(a["s"], x)
        return F.struct(state.alias("s"), F.when(F.size(new) > 0, F.concat(a["out"], new)).otherwise(a["out"]).alias("out"))

    def some(a: Column, run: Column) -> Column:
        return let(F.aggregate(run, F.struct(a["s"].alias("s"), none.alias("out")), one), lambda r: F.struct(r["s"].alias("s"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))

    outs = F.expr(f"cast(array() as array<array<{put}>>)")
    return let(F.aggregate(in_runs(elements), F.struct(begin.alias("s"), outs.alias("outs")), some), lambda a: F.struct(a["s"].alias("s"), F.flatten(a["outs"]).alias("out")))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start int, text string>>, in code points."""
    none = F.expr("cast(array() as array<struct<start: int, text: string>>)")

    def place(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        both = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        spots = let(both, lambda b: F.zip_with(starts(F.transform(b, lambda x: x["p"] + x["m"])), b, lambda s, x: s + x["p"]))
        return F.zip_with(spots, found, lambda s, m: F.struct(s.alias("start"), m.alias("text")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(place(found)))


def _pairs(words: DataFrame) -> dict[tuple[str, str], int]:
    """How often each pair of neighbouring characters occurs; at most len(ALPHABET)^2 rows come back."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = words.where(F.length("word") > 1).select(F.explode(F.transform(at, lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    return {(r.pair[0], r.pair[1]): r["n"] for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.length("pair") == 2).collect() if r.pair[0] in ALPHABET and r.pair[1] in ALPHABET}


def samples(spark: SparkSession, ordinary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled samples (word, check): random strings (digests of numbers in base64 and hexadecimal, mixed and in capitals,
    with and without digits), and identifiers made of the words of ordinary (text), plain and joined in the usual ways, and
    lines of one character or of a few digits; words are drawn by hash, WORD_ROWS at most. check marks what is kept from
    the counts."""
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    shape, mixed = F.col("id") % 5, F.base64(F.unhex(digest))
    kinds = F.when(shape == 0, digest).when(shape == 1, F.upper(F.translate(mixed, "+/=", "XYZ"))).when(shape == 2, F.regexp_replace(mixed, "[^A-Za-z]", "")).otherwise(mixed)
    random = spark.range(RANDOM_ROWS).select(kinds.alias("word"), (F.pmod(F.floor(F.col("id") / 5), F.lit(CHECK_EVERY)) == 0).alias("check"))
    words = ordinary.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[A-Za-z]{2,}"), F.lit(0))).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(WORD_ROWS)
    n = F.pmod(F.xxhash64("w"), F.lit(2030))
    number, line = n.cast("string"), lambda c: F.repeat(c, 24)
    sign = F.substr(F.lit("-=_+/0123456789abcdefABCDEFGHIJKLMNOPQRSTUVWXYZghijklmnopqrstuvwxyz"), (n % 67 + 1).cast("int"), F.lit(1))
    joined = [F.col("w"), F.lower("w"), F.upper("w"), F.concat_ws("_", "w", "w", number), F.concat_ws("-", "w", "w"), F.concat_ws("/", "w", "w", number), F.concat("w", F.initcap("w")), F.concat("w", number), F.concat(F.lit("page="), "w"), line(F.substr("w", F.lit(1), F.lit(1))), line(sign), F.substr(F.lit("01234567890123456789012345678901234567890"), (n % 10 + 1).cast("int"), F.lit(24))]
    # those that are checked are as long as the tokens that are judged
    long = [F.concat_ws(sep, "w", "w", "w", "w", "w", "w", "w", "w", "w", "w") for sep in ("", "_", "-", "/")]
    check = F.pmod(F.xxhash64("w", F.lit(1)), F.lit(CHECK_EVERY)) == 0
    return random, words.select(F.explode(F.when(check, F.array(*long)).otherwise(F.array(*joined))).alias("word"), check.alias("check"))


def fit(spark: SparkSession, ordinary: DataFrame) -> list[float]:
    """What the log-likelihood ratios of all pairs of characters, WIDE^2 of them, exceed the threshold by (0 less the
    threshold where a character is not in ALPHABET)."""
    both = samples(spark, ordinary)
    random, plain = (_pairs(x.where("not check")) for x in both)

    def logs(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
        rows = {a: sum(counts.get((a, b), 0) for b in ALPHABET) for a in ALPHABET}
        return {(a, b): math.log((counts.get((a, b), 0) + 1) / (rows[a] + len(ALPHABET))) for a in ALPHABET for b in ALPHABET}

    up, down = logs(random), logs(plain)
    model = [0.0 if not a or not b else round(up[a, b] - down[a, b], 6) for a in ["", *ALPHABET] for b in ["", *ALPHABET]]
    limit = threshold(*both, model)
    return [round(x - limit, 6) for x in model]


def threshold(random: DataFrame, plain: DataFrame, model: list[float]) -> float:
    """The ratio with the least errors on the checked samples, tokens of 20 to 40 characters: between two hundredths, the
    middle of the best range. At most some thousand counts come to the driver."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    token, cut = F.substr("word", F.lit(1), F.lit(20) + F.pmod(F.xxhash64("word"), F.lit(21)).cast("int")), F.col("cut")
    found: list[dict[int, int]] = []
    for rows in (random, plain):
        long = rows.where("check and length(word) >= 20").select(token.alias("cut"))
        mean = let(excess(cut, table), lambda s: _sum(s, F.lit(0.0)) / F.size(s))
        found.append({r["at"]: r["n"] for r in long.groupBy(F.floor(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), mean)) * 100).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()})
    up, down = found
    total = [max(1, sum(x.values())) for x in found]
    cost = {t: sum(n for k, n in up.items() if k < t) / total[0] + ALARM * sum(n for k, n in down.items() if k >= t) / total[1] for t in range(-200, 301)}
    best = [t for t in cost if cost[t] <= min(cost.values()) + 1e-12]
    return (best[0] + best[-1]) / 200


def excess(token: Column, model: Column) -> Column:
    """The model's value of each pair of neighbours in a token of two or more characters."""
    place = lambda piece: F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    numbers = F.flatten(F.transform(F.regexp_extract_all(token, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), place))
    return let(numbers, lambda n: F.zip_with(F.slice(n, 1, F.size(n) - 1), F.slice(n, 2, F.size(n) - 1), lambda a, b: F.element_at(model, a * WIDE + b + 1)))


def runs(token: Column, scores: Column) -> Column:
    """The runs of a token whose scores pass, out to the next =, / or _: array<struct<from int, to int>>."""
    state = lambda total, start, best, end, at: F.struct(total.alias("sum"), start.alias("from"), best.alias("best"), end.alias("to"), at.alias("at"))
    none = F.expr("cast(array() as array<struct<from: int, to: int>>)")
    closed = lambda a: F.when((a["to"] - a["from"] >= LEAST_RUN) & (a["best"] >= EVIDENCE), F.array(F.struct(a["from"].alias("from"), a["to"].alias("to")))).otherwise(none)

    def step(a: Column, x: Column) -> tuple[Column, Column]:
        # at: the place of the pair's first character; a run ends behind the pair's second one
        total, after = a["sum"] + x, a["at"] + 1
        ended = (total <= 0) | (total < a["best"] - DROP)
        goes_on = state(total, a["from"], F.greatest(a["best"], total), F.when(total > a["best"], after + 1).otherwise(a["to"]), after)
        return F.when(ended, state(F.lit(0.0), after, F.lit(0.0), after, after)).otherwise(goes_on), F.when(ended, closed(a)).otherwise(none)

    found = let(fold(scores, state(F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0), F.lit(0)), "struct<from: int, to: int>", step), lambda r: F.concat(r["out"], closed(r["s"])))
    # each character's part begins and ends here, the mark behind a part being its own
    lengths = F.transform(F.split(token, "[=/_]", -1), F.length)
    begins = lambda n: F.flatten(F.zip_with(starts(F.transform(n, lambda x: x + 1)), n, lambda s, x: F.array_repeat(s, x + 1)))
    ends = lambda n: F.flatten(F.zip_with(starts(F.transform(n, lambda x: x + 1)), n, lambda s, x: F.array_repeat(s + x, x + 1)))

    def widened(r: Column) -> Column:
        wide = let(lengths, lambda n: let(F.struct(begins(n).alias("b"), ends(n).alias("e")), lambda p: F.transform(r, lambda x: F.struct(F.least(x["from"], F.element_at(p["b"], x["from"] + 1)).alias("from"), F.greatest(x["to"], F.element_at(p["e"], x["to"])).alias("to")))))
        return let(wide, lambda w: F.filter(w, lambda x, k: (k == 0) | (x != F.element_at(w, F.greatest(k, F.lit(1))))))

    return let(found, lambda r: F.when(F.size(r) > 0, widened(r)).otherwise(none))


def spans(text: Column, model: list[float]) -> Column:
    """All spans of a text, by start and then kind: array<struct<start int, kind int, end int>>."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    shape = lambda k: lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), (m["start"] + F.length(m["text"])).alias("end"))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 8)
    # a token that passes is one span; of another its runs are
    kind = F.lit(KINDS.index("markov"))
    parts = lambda m: let(excess(m["text"], table), lambda s: F.when(_sum(s, F.lit(0.0)) >= 0, F.array(shape(KINDS.index("markov"))(m))).otherwise(F.transform(runs(m["text"], s), lambda r: F.struct((m["start"] + r["from"]).alias("start"), kind.alias("kind"), (m["start"] + r["to"]).alias("end")))))
    random = F.flatten(F.transform(matches(text, TOKEN), parts))
    return F.array_sort(F.concat(*(F.transform(found, shape(k)) for k, found in enumerate((assign, matches(text, ACCESS), matches(text, HEX)))), random))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of each row of docs (doc_id, text), whole texts.

    A null or empty text has no spans (the digest is that of the empty string); null ids and repeated rows are kept; no
    rows: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans(text, model).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("s", lambda x: x["kind"] < 3)
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"), count(3).alias("n_markov"))


def mask(docs: DataFrame, model: list[float]) -> DataFrame:
    """docs with every span of every text replaced by MASK (overlapping spans by one), and n_chars, where there is such a
    column, set to the new length of the texts that changed. All rows and columns stay; a null text stays null."""
    text = F.col("text")
    found = spans(F.coalesce(text, F.lit("")), model)

    def rebuilt(s: Column) -> Column:
        # pieces between spans that don't overlap, each cut from the block of text that RUN of them lie in
        def step(a: Column, x: Column) -> tuple[Column, Column]:
            none = F.expr("cast(array() as array<struct<from: int, to: int>>)")
            return F.greatest(a, x["end"]), F.when(x["start"] >= a, F.array(F.struct(a.alias("from"), x["start"].alias("to")))).otherwise(none)

        last = lambda r: F.element_at(r, -1)["to"]
        block = lambda r: let(F.substr(text, r[0]["from"] + 1, last(r) - r[0]["from"]), lambda t: F.transform(r, lambda p: F.substr(t, p["from"] - r[0]["from"] + 1, p["to"] - p["from"])))
        pieces = lambda a: F.flatten(F.transform(in_runs(a["out"]), block))
        return let(fold(s, F.lit(0), "struct<from: int, to: int>", step), lambda a: F.concat(F.array_join(pieces(a), MASK), F.lit(MASK), F.substr(text, a["s"] + 1, F.length(text))))

    new = let(found, lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(text))
    names, pair = docs.columns, "masked text"
    masked = docs.withColumn(pair, F.struct(text.alias("old"), new.alias("new")))
    old, put = F.col(f"`{pair}`.old"), {"text": F.col(f"`{pair}`.new")}
    if "n_chars" in names:
        put["n_chars"] = F.when(old != put["text"], F.length(put["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return masked.select(*(put[c].alias(c) if c in put else F.col(f"`{c}`") for c in names))
