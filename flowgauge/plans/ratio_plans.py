"""The ratio of aligned tokens and what it rests on: prompt weights, topics, the intent in force, repetition against the last
ten spans of a phase, and the cascade of labels; over transcripts derived from the given tables.

Semantic likeness is the cosine of the sets of words and word pairs of two texts: no embedding model is at hand, and this one
needs no other engine than SQL. A ring of the last ten spans is carried along a session, and no span is joined with another.
Oracles pair the spans instead.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowgauge import shared
from flowgauge.operators.repetition import top_match
from flowgauge.plans.sample_plans import EVENTS, Sample, given_events

#: What marks a prompt that gives no goal, one that corrects, one that states a goal, a constraint or a place.
OPERATIONAL = r"^(ok(ay)?|yes|yep|sure|continue|go ahead|proceed|retry|again|do it|do that|ship it|thanks?|please|(keep going|carry on|sounds good|looks good)[.!\s]*)$"
CORRECTION = "actually|instead|correction|change that|not |don''t |do not |rather than"
GOAL = "^(add |build |create |implement |fix |refactor |update |remove |write |make )"
CONSTRAINT = "must|should|ensure|without|only|minimum|maximum|use "
PLACE = r"/|[.]py|[.]json|--"
ACTIONS = "add analyze build check compare create delete edit find fix generate inspect list load move open read remove replace report run search test update validate verify write".split()
#: A path, a name or number that stands for a thing, a reference to a line or a long number, the harness' own words.
PATH = r"[A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+"
NAME = r"^([A-Za-z_][A-Za-z0-9_][A-Za-z0-9_]+|[0-9][0-9]+)$"
SPECIFIC = r"(^|[^\p{L}\p{N}_])(lines?\s+[0-9]+|[0-9][0-9][0-9]+([^\p{L}\p{N}_]|$))"
ARTIFACT = r"(?i)^\s*\[Request interrupted"
#: How like a span must be to one of the last ten of its phase.
LIKE = "case phase when 'tool_use' then 0.93D else 0.88D end"
COUNTED = r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]"

_list = "array('" + "', '".join(ACTIONS) + "')"


def _both(a: str, b: str) -> str:
    return f"size(array_intersect({a}, {b}))"


def _jaccard(a: str, b: str, empty: str) -> str:
    return f"case when size({a}) + size({b}) = 0 then {empty} else {_both(a, b)} * 1.0D / (size({a}) + size({b}) - {_both(a, b)}) end"


def _cosine(a: str, b: str) -> str:
    return f"case when size({a}) = 0 or size({b}) = 0 then 0.0D else {_both(a, b)} / sqrt(size({a}) * 1.0D * size({b})) end"


_FEATURES = "array_distinct(concat(w, transform(filter(sequence(1, size(w)), i -> i < size(w)), i -> concat(w[i - 1], ' ', w[i]))))"
_THINGS = f"array_distinct(concat(transform(regexp_extract_all(text, r'{PATH}', 0), x -> lower(x)), transform(filter(regexp_extract_all(regexp_replace(text, r'{PATH}', ' '), r'[\\p{{{{L}}}}\\p{{{{N}}}}_]+', 0), x -> x rlike r'{NAME}'), x -> lower(x))))"
PROMPTS = f"""p0 as (select session_id, sequence as seq, text, lower(trim(text)) as low, regexp_extract_all(lower(text), '[a-z0-9_]+', 0) as w, size(regexp_extract_all(text, '[A-Za-z0-9_./-]+', 0)) as n_tokens,
  size(filter(split(trim(text), r'\\s+'), x -> x <> '')) as n_words, regexp_replace(regexp_replace(lower(trim(text)), r'\\s+', ' '), '^[.!?,;:]+|[.!?,;:]+$', '') as plain from {{e}} where kind = 'intent.stated'),
p1 as (select *, {_FEATURES} as f, plain = '' or plain rlike r'{OPERATIONAL}' as operational, low rlike "{CORRECTION.replace("''", "'")}" as correction from p0),
p2 as (select *, case when operational then 0.05D else least(1.0D, 0.25D + least(1.0D, n_tokens / 18.0D) * 0.65D + case when low rlike '{GOAL}' then 0.18D else 0.0D end + case when low rlike '{CONSTRAINT}' then 0.12D else 0.0D end + case when text rlike '{PLACE}' then 0.08D else 0.0D end) end as information,
  last_value(case when not operational then f end) ignore nulls over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as before from p1),
p3 as (select *, case when before is not null and not operational then {_cosine('before', 'f')} end as similarity from p2),
p4 as (select *, cast(sum(case when similarity < 0.42D * case when correction then 0.65D else 1.0D end then 1 else 0 end) over (partition by session_id order by seq) as bigint) as topic from p3),
p5 as (select *, count(*) over t as n, row_number() over (partition by session_id, topic order by seq) as place, max(topic) over (partition by session_id) as last_topic from p4 window t as (partition by session_id, topic)),
p6 as (select *, information * (0.75D + 0.25D * (place - 1) / greatest(1, n - 1)) * case when correction then 1.35D else 1.0D end * case when operational then 0.1D else 1.0D end as value from p5),
p7 as (select *, value / sum(value) over (partition by session_id, topic) as weight from p6)"""
CONFIDENCE = """c0 as (select session_id, count(*) as topic_prompts, min(seq) as topic_start, max(topic) as shifts, count(case when not operational then 1 end) as informative, sum(n_words) as all_words, sum(case when not operational then n_words end) as told_words, max(correction and not operational) as corrected from p7 where topic = last_topic group by session_id),
c1 as (select *, case when informative > 0 then told_words else all_words end as words from c0),
c2 as (select *, case when words <= 1 then 0.2D when words <= 2 then 0.3D when words <= 5 then 0.5D when words <= 10 then 0.7D else 0.85D end as base from c1),
c3 as (select *, case when informative > 1 then least(0.95D, base + least(0.1D, informative * 0.03D)) else base end as more from c2),
c4 as (select *, round(case when informative > 0 and corrected then least(0.95D, more + 0.03D) else more end, 2) as own from c3),
c5 as (select session_id, topic_start, topic_prompts, shifts, case when shifts > 0 then greatest(0.0D, round(own - 0.05D, 2)) else own end as confidence from c4)"""
CENTRE = """f0 as (select session_id, feature, sum(weight / sqrt(size(f))) as share from (select session_id, weight, f, explode(f) as feature from p7 where topic = last_topic) x group by session_id, feature),
f1 as (select session_id, count(*) as features, sqrt(sum(share * share)) as length, map_from_entries(collect_list(struct(feature, share))) as centre, array_sort(collect_list(struct(-round(share, 9) as s, feature))) as ranked from f0 group by session_id)"""
SPANS = f"""s0 as (select session_id, sequence as seq, case kind when 'reasoning' then 'reasoning' when 'response' then 'generation' else 'tool_use' end as phase, case when kind = 'tool.requested' then concat(tool_name, ' ', arguments) else text end as text, tool_name, arguments,
  array(coalesce(path, ''), trim(regexp_replace(coalesce(command, ''), r'\\s+', ' ')), coalesce(get_json_object(arguments, '$.pattern'), get_json_object(arguments, '$.query'), ''), concat_ws(':', get_json_object(arguments, '$.offset'), get_json_object(arguments, '$.limit'))) as facts from {{e}} where kind in ('reasoning', 'response', 'tool.requested')),
s1 as (select *, regexp_extract_all(lower(text), '[a-z0-9_]+', 0) as w, array_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.:/-]*|[0-9]+', 0)) as t, {_THINGS} as things, size(filter(split(trim(text), r'\\s+'), x -> x <> '')) as n_words, regexp_count(text, r'{COUNTED}') as tokens from s0),
s2 as (select *, {_FEATURES} as f, array_intersect(t, {_list}) as acts from s1),
s3 as (select *, collect_list(struct(seq, f, t, things, acts, tool_name, facts, arguments)) over (partition by session_id, phase order by seq rows between 10 preceding and 1 preceding) as ring from s2),
s4 as (select *, transform(ring, r -> struct({_cosine('r.f', 'f')} as sem, {_jaccard('r.t', 't', '1.0D')} as lex, {_jaccard('r.things', 'things', '1.0D')} as ent, {_jaccard('r.acts', 'acts', '0.0D')} as act,
  case when r.tool_name <> tool_name then 1.0D when r.facts <> facts then size(filter(sequence(0, 3), k -> r.facts[k] <> facts[k])) / 4.0D when r.arguments <> arguments then 0.25D else 0.0D end as new, coalesce(r.tool_name = tool_name, false) as same, coalesce(r.tool_name = tool_name and r.arguments = arguments, false) as exact, r.seq as seq)) as pairs from s3),
s5 as (select *, array_max(transform(pairs, x -> struct(case when phase <> 'tool_use' then (0.82D * x.sem + 0.18D * (0.45D * x.lex + 0.3D * x.ent + 0.25D * x.act)) * (1.0D - 0.3D * (1.0D - x.ent)) when x.exact then 1.0D
  else (0.45D * x.sem + 0.15D * x.lex + 0.1D * x.ent + 0.3D * case when x.same then 1.0D else 0.0D end) * (1.0D - 0.85D * x.new) end as score, -x.seq as back))) as best from s4),
s6 as (select session_id, seq, phase, text, f, n_words, tokens, coalesce(best.score, 0.0D) as score, case when best.score > 0 then -best.back end as earlier from s5)"""
LABELS = f"""l0 as (select s.*, case when size(s.f) = 0 or c.length is null or c.length = 0 then 0.0D else aggregate(s.f, 0.0D, (a, x) -> a + coalesce(c.centre[x], 0.0D)) / (sqrt(size(s.f)) * c.length) end as sim from s6 s left join f1 c on c.session_id = s.session_id),
l1 as (select *, text rlike r'{ARTIFACT}' as artifact, lower(text) rlike r'{SPECIFIC.replace("{", "{{").replace("}", "}}")}' as specific, score >= {LIKE} as again from l0),
l2 as (select *, case when artifact then if(phase = 'reasoning', 'aligned_reasoning', 'aligned_response')
  when again and not (phase = 'reasoning' and specific) then case phase when 'reasoning' then 'redundant_reasoning' when 'tool_use' then 'unnecessary_tool_call' else 'over_explanation' end
  when again then 'aligned_reasoning'
  when phase = 'reasoning' then if(sim < 0.112D and n_words < 15 or sim < 0.35D and n_words < 25 and not specific, 'redundant_reasoning', 'aligned_reasoning')
  when phase = 'tool_use' then 'aligned_tool_call'
  else if(sim < 0.088D and n_words > 50, 'over_explanation', 'aligned_response') end as label from l1),
l3 as (select *, label in ('redundant_reasoning', 'unnecessary_tool_call', 'over_explanation') as waste, case when artifact then 0.5D when again and label not like 'aligned%' then score when again then greatest(0.5D, sim)
  when label = 'redundant_reasoning' then if(sim < 0.112D and n_words < 15, 0.5D, 0.6D) when label = 'over_explanation' then 0.4D when phase = 'tool_use' then greatest(0.6D, sim) else greatest(0.5D, sim) end as confidence from l2),
l4 as (select *, case when waste and again then 'repetition' when label = 'redundant_reasoning' then 'low_information_reasoning' when label = 'over_explanation' then 'low_relevance_generation' when score > 0 then 'novel_or_below_threshold' else 'aligned_default' end as reason from l3)"""
PHASES = "r0 as (select session_id, phase, cast(sum(tokens) as bigint) as tokens, cast(sum(case when waste then 0 else tokens end) as bigint) as aligned from l4 group by session_id, phase), r1 as (select *, coalesce(round(aligned * 1.0D / nullif(tokens, 0), 4), 1.0D) as score from r0)"

#: What SPANS says of a span alone, and what it is like: the pairs of a ring are met by flowgauge.operators.repetition.
ALONE = "with " + SPANS[: SPANS.index(",\ns3 as")] + " select session_id, cast(seq as bigint) as seq, phase, text, f, t, things, acts, tool_name, facts, arguments, n_words, tokens from s2"
MET = "s6 as (select session_id, seq, phase, text, f, n_words, tokens, score, earlier from {r})"


@dataclass(frozen=True)
class Ringed(Sample):
    """A query over spans, each met with the last ten of its phase: what SPANS states, done in one pass over a session."""

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        said = frames["e"].where("kind in ('reasoning', 'response', 'tool.requested')").select("session_id", "sequence", "kind", "text", "tool_name", "arguments", "path", "command")
        spans = spark.sql(ALONE, e=said.repartition("session_id").sortWithinPartitions("session_id", "sequence"))
        text = self.sql.replace(SPANS, MET)
        return spark.sql(text, r=top_match(spans), **frames if "{e}" in text else {})


@dataclass(frozen=True)
class Told(Sample):
    """A query that reads weighted prompts several times: prompts, few of all events, are written once."""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        prompts = given_events(spark, sf_dir).where("kind = 'intent.stated'").select("session_id", "sequence", "kind", "text")
        return self.apply(spark, e=shared.held(prompts))


# The oracles' own words: prompts and spans are paired by joins, features are rows.
_D_FEATURES = "list_distinct(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
D_PROMPTS = rf"""{EVENTS},
q0 as (select session_id, idx as seq, text, lower(trim(text)) as low, regexp_extract_all(lower(text), '[a-z0-9_]+') as w, len(regexp_extract_all(text, '[A-Za-z0-9_./-]+')) as n_tokens, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) as n_words from ev where kind = 'prompt'),
q1 as (select *, {_D_FEATURES} as f, trim(regexp_replace(low, '\s+', ' ', 'g'), '.!?,;:') as plain, regexp_matches(low, '{CORRECTION}') as correction from q0),
q2 as (select *, plain = '' or regexp_matches(plain, '{OPERATIONAL}') as operational from q1),
q3 as (select *, if(operational, 0.05::double, least(1, 0.25::double + least(1, n_tokens / 18) * 0.65::double + if(regexp_matches(low, '{GOAL}'), 0.18::double, 0) + if(regexp_matches(low, '{CONSTRAINT}'), 0.12::double, 0) + if(regexp_matches(text, '{PLACE}'), 0.08::double, 0))) as information,
  (select max(b.seq) from q2 b where b.session_id = q2.session_id and b.seq < q2.seq and not b.operational) as last from q2),
q4 as (select a.*, coalesce(not a.operational and b.seq is not null and len(list_intersect(a.f, b.f)) / sqrt(greatest(1, len(a.f)) * greatest(1, len(b.f))) < if(a.correction, 0.273::double, 0.42::double), false) as shift from q3 a left join q3 b on b.session_id = a.session_id and b.seq = a.last),
q5 as (select *, (select count(*) from q4 b where b.session_id = q4.session_id and b.shift and b.seq <= q4.seq) as topic from q4),
q6 as (select *, (select max(b.topic) from q5 b where b.session_id = q5.session_id) as last_topic, count(*) over (partition by session_id, topic) as n, rank() over (partition by session_id, topic order by seq) as place from q5),
q7 as (select *, information * (0.75::double + (place - 1) / (4 * greatest(1, n - 1))) * if(correction, 1.35::double, 1) * if(operational, 0.1::double, 1) as value from q6),
q8 as (select *, value / (select sum(b.value) from q7 b where b.session_id = q7.session_id and b.topic = q7.topic) as weight from q7)"""
D_CONFIDENCE = """g0 as (select session_id, min(seq) as topic_start, count(*) as topic_prompts, max(topic) as shifts, count(*) filter (where not operational) as told, coalesce(sum(n_words) filter (where not operational), sum(n_words)) as words, bool_or(correction and not operational) as corrected from q8 where topic = last_topic group by all),
g1 as (select *, (case when words > 10 then 85 when words > 5 then 70 when words > 2 then 50 when words > 1 then 30 else 20 end) as base from g0),
g2 as (select *, if(told > 1, least(95, base + least(10, 3 * told)), base) as more from g1),
g3 as (select session_id, topic_start, topic_prompts, shifts, (if(corrected, least(95, more + 3), more) - if(shifts > 0, 5, 0))::double / 100 as confidence from g2)"""
D_CENTRE = """h0 as (select session_id, feature, sum(weight / sqrt(n)) as share from (select session_id, weight, len(f) as n, unnest(f) as feature from q8 where topic = last_topic) x group by all)"""
D_SPANS = rf"""t0 as (select session_id, idx as seq, case kind when 'reasoning' then 'reasoning' when 'response' then 'generation' else 'tool_use' end as phase, if(kind = 'request', tool_name || ' ' || cast(input as varchar), text) as text, tool_name, cast(input as varchar) as whole,
  [coalesce(path, ''), trim(regexp_replace(coalesce(raw_command, ''), '\s+', ' ', 'g')), coalesce(json_extract_string(input, '$.pattern'), '')] as facts from ev where kind in ('reasoning', 'response', 'request')),
t1 as (select *, regexp_extract_all(lower(text), '[a-z0-9_]+') as w, list_distinct(regexp_extract_all(lower(text), '[a-z_][a-z0-9_.:/-]*|[0-9]+')) as t, row_number() over (partition by session_id, phase order by seq) as n,
  list_distinct(list_transform(regexp_extract_all(text, '{PATH}') || list_filter(regexp_extract_all(regexp_replace(text, '{PATH}', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '{NAME}')), lambda x: lower(x))) as things from t0),
t2 as (select *, {_D_FEATURES} as f, list_intersect(t, ['{"', '".join(ACTIONS)}']) as acts from t1),
u0 as (select a.session_id, a.phase, a.seq, b.seq as earlier, if(len(a.f) = 0 or len(b.f) = 0, 0, len(list_intersect(a.f, b.f)) / sqrt(greatest(1, len(a.f) * len(b.f)))) as sem, if(len(a.t) + len(b.t) = 0, 1, len(list_intersect(a.t, b.t)) / len(list_distinct(a.t || b.t))) as lex, if(len(a.things) + len(b.things) = 0, 1, len(list_intersect(a.things, b.things)) / len(list_distinct(a.things || b.things))) as ent,
  if(len(a.acts) + len(b.acts) = 0, 0, len(list_intersect(a.acts, b.acts)) / len(list_distinct(a.acts || b.acts))) as act, a.tool_name = b.tool_name as same, a.tool_name = b.tool_name and a.whole = b.whole as exact, case when a.tool_name <> b.tool_name then 1 when a.facts <> b.facts then len(list_filter([1, 2, 3], lambda k: a.facts[k] <> b.facts[k])) / 4 when a.whole <> b.whole then 0.25 else 0 end as new
  from t2 a join t2 b on b.session_id = a.session_id and b.phase = a.phase and b.n between a.n - 10 and a.n - 1),
u1 as (select *, case when phase <> 'tool_use' then (0.82::double * sem + 0.18::double * (0.45::double * lex + 0.3::double * ent + 0.25::double * act)) * (0.7::double + 0.3::double * ent) when exact then 1 else (0.45::double * sem + 0.15::double * lex + 0.1::double * ent + if(same, 0.3::double, 0)) * (1 - 0.85::double * new) end as score from u0),
u2 as (select session_id, seq, score, earlier from (select *, row_number() over (partition by session_id, seq order by score desc, earlier) as r from u1 where score > 0) x where r = 1),
u3 as (select t2.*, coalesce(u2.score, 0) as score, u2.earlier from t2 left join u2 on u2.session_id = t2.session_id and u2.seq = t2.seq)"""
D_LABELS = rf"""v0 as (select session_id, sqrt(sum(share * share)) as length from h0 group by session_id), v1 as (select x.session_id, x.seq, sum(h.share) as share from (select session_id, seq, unnest(f) as feature from u3) x join h0 h on h.session_id = x.session_id and h.feature = x.feature group by all),
v2 as (select u3.*, coalesce(v1.share / (v0.length * sqrt(len(u3.f))), 0) as sim, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) as n_words, len(regexp_extract_all(text, '{COUNTED}')) as tokens from u3 left join v0 on v0.session_id = u3.session_id left join v1 on v1.session_id = u3.session_id and v1.seq = u3.seq),
v3 as (select *, regexp_matches(text, '{ARTIFACT}') as artifact, regexp_matches(lower(text), '{SPECIFIC}') as specific, score >= if(phase = 'tool_use', 0.93, 0.88) as again, case phase when 'reasoning' then ['aligned_reasoning', 'redundant_reasoning'] when 'tool_use' then ['aligned_tool_call', 'unnecessary_tool_call'] else ['aligned_response', 'over_explanation'] end as names from v2),
v4 as (select *, case when artifact then 'artifact' when again then if(phase = 'reasoning' and specific, 'kept', 'repeated') when phase = 'reasoning' and sim < 0.112 and n_words < 15 then 'filler' when phase = 'reasoning' and sim < 0.35 and n_words < 25 and not specific then 'narration' when phase = 'generation' and sim < 0.088 and n_words > 50 then 'verbose' else 'fine' end as tier from v3),
v5 as (select *, tier in ('repeated', 'filler', 'narration', 'verbose') as waste, case tier when 'artifact' then 0.5 when 'repeated' then score when 'filler' then 0.5 when 'narration' then 0.6 when 'verbose' then 0.4 else greatest(sim, if(phase = 'tool_use', 0.6, 0.5)) end as confidence,
  case tier when 'repeated' then 'repetition' when 'filler' then 'low_information_reasoning' when 'narration' then 'low_information_reasoning' when 'verbose' then 'low_relevance_generation' else if(score > 0, 'novel_or_below_threshold', 'aligned_default') end as reason from v4),
v6 as (select *, case when tier = 'artifact' and phase <> 'reasoning' then 'aligned_response' when waste then names[2] else names[1] end as label from v5)"""
D_PHASES = "w0 as (select session_id, phase, sum(tokens)::bigint as tokens, coalesce(sum(tokens) filter (where not waste), 0)::bigint as aligned from v6 group by all), w1 as (select *, if(tokens = 0, 1, round(aligned / nullif(tokens, 0), 4))::double as score from w0)"

_told, _all = f"with {PROMPTS}", f"with {PROMPTS}, {CENTRE}, {SPANS}, {LABELS}"
_d_all = f"{D_PROMPTS}, {D_CENTRE}, {D_SPANS}, {D_LABELS}"
PLANS = [
    Sample("p34_information_score", f"{_told} select session_id, seq, round(information, 4) as information, operational, correction from p7", D_PROMPTS, "select session_id, seq, round(information, 4) as information, operational, correction from q8"),
    Sample("w27_prompt_weights", f"{_told} select session_id, seq, topic, round(weight, 6) as weight from p7", D_PROMPTS, "select session_id, seq, topic, round(weight, 6) as weight from q8"),
    Sample("w28_topic_shift", f"{_told} select session_id, seq, topic, round(similarity, 4) as similarity from p7", D_PROMPTS,
           "select a.session_id, a.seq, a.topic, case when not a.operational and b.seq is not null then round(len(list_intersect(a.f, b.f)) / sqrt(greatest(1, len(a.f) * len(b.f))), 4) end as similarity from q8 a left join q8 b on b.session_id = a.session_id and b.seq = a.last"),
    Told("b4_latest_topic_intent", f"{_told}, {CONFIDENCE}, {CENTRE} select c.session_id, topic_start, topic_prompts, shifts, confidence, features, round(length, 6) as length, array_join(transform(slice(ranked, 1, 5), x -> x.feature), ', ') as leading from c5 c left join f1 f on f.session_id = c.session_id", f"{D_PROMPTS}, {D_CONFIDENCE}, {D_CENTRE}",
           "select g.session_id, topic_start, topic_prompts, shifts, confidence, h.features, h.length, h.leading from g3 g left join (select session_id, count(*) as features, round(sqrt(sum(share * share)), 6) as length, array_to_string(list(feature order by round(share, 9) desc, feature)[1:5], ', ') as leading from h0 group by all) h on h.session_id = g.session_id"),
    Ringed("w23_repetition_top_match", f"with {SPANS} select session_id, seq, phase, earlier, round(score, 4) as score from s6 where earlier is not null", f"{EVENTS}, {D_SPANS}", "select session_id, seq, phase, earlier, round(score, 4) as score from u3 where earlier is not null"),
    Ringed("w24_label_cascade", f"{_all} select session_id, seq, phase, label, reason, round(confidence, 4) as confidence from l4", _d_all, "select session_id, seq, phase, label, reason, round(confidence, 4) as confidence from v6"),
    Ringed("a1_ratio_by_phase", f"{_all}, {PHASES} select session_id, phase, tokens, aligned, score from r1", f"{_d_all}, {D_PHASES}", "select session_id, phase, tokens, aligned, score from w1"),
    Ringed("a1_ratio_aggregate", f"{_all}, {PHASES} select session_id, round(0.3D * coalesce(max(case when phase = 'reasoning' then score end), 1.0D) + 0.4D * coalesce(max(case when phase = 'tool_use' then score end), 1.0D) + 0.3D * coalesce(max(case when phase = 'generation' then score end), 1.0D), 4) as aggregate_ratio, round(sum(aligned) * 1.0D / nullif(sum(tokens), 0), 4) as raw_ratio from r1 group by session_id", f"{_d_all}, {D_PHASES}",
           "select session_id, round(0.3::double * coalesce(max(score) filter (where phase = 'reasoning'), 1) + 0.4::double * coalesce(max(score) filter (where phase = 'tool_use'), 1) + 0.3::double * coalesce(max(score) filter (where phase = 'generation'), 1), 4) as aggregate_ratio, round(sum(aligned) / sum(tokens), 4) as raw_ratio from w1 group by session_id"),
    Ringed("a3_uncertainty", f"{_all} select session_id, round(avg(confidence), 6) as mean_confidence, round(sum(tokens * confidence) / nullif(sum(tokens), 0), 6) as weighted_confidence, round(avg(case when confidence < 0.65D then 1.0D else 0.0D end), 6) as low_share, case when count(*) < 10 then 'low' when count(*) < 50 then 'moderate' else 'high' end as reliability from l4 group by session_id", _d_all,
           "select session_id, round(avg(confidence), 6) as mean_confidence, round(sum(tokens * confidence) / sum(tokens), 6) as weighted_confidence, round((count(*) filter (where confidence < 0.65)) / count(*), 6) as low_share, case when count(*) >= 50 then 'high' when count(*) >= 10 then 'moderate' else 'low' end as reliability from v6 group by session_id"),
]
