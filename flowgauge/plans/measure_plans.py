"""Plans across sessions: evaluation, control charts, strata, pricing, histories, and documents as fragments."""

from __future__ import annotations

from flowgauge.plans.catalog import Plan

#: A session's daily measure: a customer's tokens in the order of their turns.
CONTROL = """m as (select session_id, seq, tokens * 1.0 as x, abs(tokens - lag(tokens) over (partition by session_id order by seq)) * 1.0 as mr from {t}),
l as (select session_id, count(*) as n, avg(x) as centre, avg(mr) as mr_bar from m group by session_id having count(*) >= 8)"""
SIGNALS = f"with {CONTROL}, z as (select m.session_id, m.seq, m.x, l.centre, l.mr_bar / 1.128 as sigma, case when l.mr_bar > 0 then (m.x - l.centre) / (l.mr_bar / 1.128) end as d from m join l on l.session_id = m.session_id)"
#: A point beyond so many sigmas on a side, where most of the last points are; a side counts where its natural limit exists.
ZONE = """ select session_id, seq from (select session_id, seq, d, centre, sigma, sum(case when d > {far} then 1 else 0 end) over w as above, sum(case when d < -{far} then 1 else 0 end) over w as below from z window w as (partition by session_id order by seq rows between {back} preceding and current row)) y
where (d > {far} and above >= {least}) or (d < -{far} and below >= {least} and centre - 2.66 * 1.128 * sigma >= 0)"""
SIDES = """with x as (select session_id, seq, tokens::double as v, row_number() over (partition by session_id order by seq) as n from {t}),
s as (select a.session_id, avg(a.v) as centre, avg(abs(a.v - b.v)) as mr from x a left join x b on b.session_id = a.session_id and b.n = a.n - 1 group by a.session_id having count(*) >= 8),
k as (select x.*, (x.v - s.centre) / (s.mr / 1.128) as d, x.v > s.centre or s.centre - 2.66 * s.mr >= 0 as open from x join s on s.session_id = x.session_id where s.mr > 0)"""
#: Dated rates in dollars for a million tokens.
PRICES = "(select * from (values ('small', date '1990-01-01', 3.0), ('small', date '1995-01-01', 2.0), ('large', date '1990-01-01', 15.0), ('large', date '1994-07-01', 12.0), ('large', date '1997-01-01', 10.0)) as v(model, effective_from, rate))"
#: The price of a turn is that of the latest entry of its model that is in force on its day.
PRICED = f"with p as {PRICES}, q as (select t.session_id, t.seq, t.turn_id, t.tokens, t.model, t.day, p.rate, p.effective_from, row_number() over (partition by t.turn_id order by p.effective_from desc) as r from {{t}} t join p on p.model = t.model and p.effective_from <= t.day)"
BINARY = "count(*) filter (where gold = 1 and pred = 1) as tp, count(*) filter (where gold = 0 and pred = 1) as fp, count(*) filter (where gold = 0 and pred = 0) as tn, count(*) filter (where gold = 1 and pred = 0) as fn"
RATES = "round(tp * 1.0 / nullif(tp + fp, 0), 4) as precision_, round(tp * 1.0 / nullif(tp + fn, 0), 4) as recall_, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 4) as f1, round(1.25 * tp / nullif(1.25 * tp + 0.25 * fn + fp, 0), 4) as f05, round((tp + tn) * 1.0 / nullif(tp + fp + tn + fn, 0), 4) as accuracy"
#: Classes of what redaction takes out, in order.
REDACT = {"aws_access_key": "AKIA[A-Z0-9]{16}", "assigned_secret": "(?:password|secret|token|api_key)[ ]*[:=][ ]*[A-Za-z0-9_.-]{6,}", "email": "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]{2,}", "ipv4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "hex_key": "[0-9a-f]{32,}"}

PLANS = [
    Plan("a33_binary_metrics", f"with b as (select lang, {BINARY} from {{j}} group by lang) select lang, tp, fp, tn, fn, {RATES} from b"),
    Plan("a33_token_weighted", f"with b as (select cast(sum(case when gold = 1 and pred = 1 then tokens else 0 end) as bigint) as tp, cast(sum(case when gold = 0 and pred = 1 then tokens else 0 end) as bigint) as fp, cast(sum(case when gold = 0 and pred = 0 then tokens else 0 end) as bigint) as tn, cast(sum(case when gold = 1 and pred = 0 then tokens else 0 end) as bigint) as fn from {{j}}) select tp, fp, tn, fn, {RATES} from b"),
    Plan("a34_confusion", "select gold, pred, count(*) as n, cast(grouping(gold) as bigint) as all_gold, cast(grouping(pred) as bigint) as all_pred from {j} group by cube (gold, pred)"),
    Plan("a34_per_label", "select label, count(*) filter (where gold = label) as support, round(count(*) filter (where gold = label and pred = label) * 1.0 / nullif(count(*) filter (where pred = label), 0), 4) as precision_, round(count(*) filter (where gold = label and pred = label) * 1.0 / nullif(count(*) filter (where gold = label), 0), 4) as recall_ from {j} cross join (select 0 as label union all select 1 as label) l group by label"),
    Plan("a35_threshold_calibration", """
with s as (select score, count(*) filter (where gold = 1) as up, count(*) filter (where gold = 0) as down from {j} group by score),
c as (select score as threshold, sum(up) over (order by score desc) as tp, sum(down) over (order by score desc) as fp, sum(up) over () as total from s),
f as (select threshold, round(1.25 * tp / nullif(1.25 * tp + 0.25 * (total - tp) + fp, 0), 6) as f_beta, round(tp * 1.0 / nullif(tp + fp, 0), 6) as precision_ from c)
select threshold, f_beta, precision_ from (select *, row_number() over (order by f_beta desc, precision_ desc, threshold desc) as r from f) x where r = 1"""),
    Plan("a37_regression_gates", """
with b as (select count(*) filter (where gold = pred) * 1.0 / count(*) as base, count(*) filter (where gold = case when score >= 0.5 then 1 else 0 end) * 1.0 / count(*) as cand, count(*) as n from {j})
select 'accuracy' as gate, round(base, 4) as baseline, round(cand, 4) as candidate, round(cand - base, 4) as delta, cand - base >= -0.02 as passed from b union all select 'size' as gate, n * 1.0 as baseline, n * 1.0 as candidate, 0.0 as delta, n >= 10 as passed from b"""),
    Plan("a38_history_trend", """
with n as (select session_id, tokens, row_number() over (partition by session_id order by seq) as i, count(*) over (partition by session_id) as n from {t}),
h as (select session_id, avg(case when i <= floor(n / 2) then tokens end) as first_half, avg(case when i > floor(n / 2) then tokens end) as second_half from n where n >= 4 group by session_id)
select session_id, round(first_half, 4) as first_half, round(second_half, 4) as second_half, case when second_half > first_half * 1.02 then 'rising' when second_half < first_half * 0.98 then 'falling' else 'stable' end as trend from h"""),
    Plan("a30_strata_quartiles", "select lang, gold, count(*) as n, round(percentile(tokens, 0.25), 4) as q1, round(percentile(tokens, 0.5), 4) as median, round(percentile(tokens, 0.75), 4) as q3, round(avg(case when tokens > 0 then 1.0 else 0.0 end), 4) as positive_share from {j} group by lang, gold having count(*) >= 5"),
    Plan("a32_natural_limits", f"with {CONTROL} select session_id, n, round(centre, 6) as centre, round(mr_bar, 6) as mr_bar, round(centre + 2.66 * mr_bar, 6) as upper, case when centre - 2.66 * mr_bar >= 0 then round(centre - 2.66 * mr_bar, 6) end as lower, round(mr_bar / 1.128, 6) as sigma, round(3.268 * mr_bar, 6) as mr_upper from l"),
    Plan("w38_control_points", SIGNALS + " select session_id, seq, round(x, 4) as x, round(d, 6) as distance from z"),
    Plan("w39_beyond_limits", SIGNALS + " select session_id, seq, round(x, 4) as x, case when x > centre + 2.66 * 1.128 * sigma + 1e-9 then 'above' else 'below' end as side from z where x > centre + 2.66 * 1.128 * sigma + 1e-9 or (centre - 2.66 * 1.128 * sigma >= 0 and x < centre - 2.66 * 1.128 * sigma - 1e-9)"),
    Plan("w40_two_of_three", SIGNALS + ZONE.format(far=2, back=2, least=2),
         SIDES + " select a.session_id, a.seq from k a where abs(a.d) > 2 and a.open and (select count(*) from k b where b.session_id = a.session_id and b.n between a.n - 2 and a.n and abs(b.d) > 2 and sign(b.d) = sign(a.d)) >= 2"),
    Plan("w40_four_of_five", SIGNALS + ZONE.format(far=1, back=4, least=4),
         SIDES + " select a.session_id, a.seq from k a where abs(a.d) > 1 and a.open and (select count(*) from k b where b.session_id = a.session_id and b.n between a.n - 4 and a.n and abs(b.d) > 1 and sign(b.d) = sign(a.d)) >= 4"),
    Plan("w41_run_of_eight", SIGNALS + " select session_id, seq from (select session_id, seq, count(*) over w as n, min(sign(d)) over w as lo, max(sign(d)) over w as hi from z window w as (partition by session_id order by seq rows between 7 preceding and current row)) y where n = 8 and lo = hi and lo <> 0"),
    Plan("a8_input_growth", """
with g as (select session_id, seq, tokens, tokens - 2 * lag(tokens, 1) over (partition by session_id order by seq) + lag(tokens, 2) over (partition by session_id order by seq) as second_difference from {t} where tokens > 100)
select session_id, count(*) as n, round(max_by(tokens, seq) * 1.0 / min_by(tokens, seq), 4) as growth, coalesce(avg(second_difference) > 0, false) as superlinear, coalesce(avg(second_difference) > 0 and max_by(tokens, seq) * 1.0 / min_by(tokens, seq) > 2, false) as bloat from g group by session_id"""),
    Plan("a5_usage_totals", "select model, count(*) as turns, cast(sum(tokens) as bigint) as tokens, count(distinct session_id) as sessions from {t} group by model"),
    Plan("j11_price_asof", PRICED + " select turn_id, model, cast(effective_from as varchar(10)) as effective_from, rate * 1.0 as rate from q where r = 1"),
    Plan("a25_session_pricing", PRICED + " select session_id, model, count(*) as turns, round(sum(tokens * cast(rate as double)) / 1000000.0, 6) as dollars from q where r = 1 group by session_id, model"),
    Plan("a6_waste_cost", PRICED + " select session_id, round(sum(case when tokens > 1500 then (tokens - 1500) * cast(rate as double) else 0 end) / 1000000.0, 6) as excess_dollars, round(sum(tokens * cast(rate as double)) / 1000000.0, 6) as dollars from q where r = 1 group by session_id"),
    Plan("a13_tier_savings", PRICED + ", w as (select session_id, sum(tokens * cast(rate as double)) / 1000000.0 as dollars, sum(tokens) as tokens from q where r = 1 group by session_id) select session_id, tier, round(dollars - tokens * tier_rate / 1000000.0, 6) as saving from w cross join (select 'economy' as tier, cast(1.0 as double) as tier_rate union all select 'standard' as tier, cast(5.0 as double) as tier_rate) x"),
    Plan("a27_carrying_cost", PRICED + " select session_id, seq, round(tokens * sum(cast(rate as double)) over (partition by session_id order by seq rows between 1 following and unbounded following) / 10000000.0, 6) as carrying_dollars from q where r = 1"),
    Plan("a14_group_aggregate", "select model, round(sum(tokens * ratio) / nullif(sum(tokens), 0), 4) as weighted, round(avg(ratio), 4) as plain from (select model, session_id, sum(tokens) as tokens, round(count(*) filter (where tokens < 1500) * 1.0 / count(*), 4) as ratio from {t} group by model, session_id) x group by model"),
    Plan("k1_fragment_dedup", "select sha2(text, 256) as fragment, min(doc_id) as first_doc, count(*) as copies from {d} group by sha2(text, 256)"),
    Plan("k6_version_skew", "select source, count(distinct sha2(text, 256)) as versions, count(*) as docs, case when count(distinct sha2(text, 256)) > 10 then 'high' when count(distinct sha2(text, 256)) > 1 then 'low' else 'none' end as severity from {d} group by source"),
    Plan("k5_delta_prompt", "with f as (select source, doc_id, length(text) as n, row_number() over (partition by source, sha2(text, 256) order by doc_id) as nth from {d}) select source, count(*) filter (where nth > 1) as hits, count(*) filter (where nth = 1) as misses, round(1.0 - sum(case when nth = 1 then n else 0 end) * 1.0 / nullif(sum(n), 0), 4) as saved from f group by source"),
    Plan("s21_redaction_counts", "select lang, " + ", ".join(f"cast(sum(regexp_count(text, '{p}')) as bigint) as {n}" for n, p in REDACT.items()) + " from {d} group by lang"),
    # a text's words are sorted, and counted by where each kind of them begins: nothing is shuffled
    Plan("p39_semantic_density", """
with w as (select doc_id, sort_array(regexp_extract_all(lower(text), '[a-z]+', 0)) as w from {d}),
b as (select doc_id, size(w) as total, filter(transform(w, (x, i) -> case when i = 0 or x <> w[i - 1] then i else -1 end), i -> i >= 0) as starts from w where size(w) > 0),
t as (select doc_id, total, size(starts) as kinds, aggregate(transform(starts, (s, k) -> coalesce(get(starts, k + 1), total) - s), cast(0 as double), (a, n) -> a + n * ln(n)) as nlogn from b)
select doc_id, cast(total as bigint) as words, round(kinds * 1.0 / total, 4) as type_ratio, case when kinds > 1 then round((ln(total) - nlogn / total) / ln(kinds), 4) else 0.0 end as entropy from t""",
         """
with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+', 0)) as w from {d}),
c as (select doc_id, w, count(*) as n from w group by doc_id, w),
t as (select doc_id, sum(n) as total, count(*) as kinds, sum(n * ln(n)) as nlogn from c group by doc_id)
select doc_id, cast(total as bigint) as words, round(kinds * 1.0 / total, 4) as type_ratio, case when kinds > 1 then round((ln(total) - nlogn / total) / ln(kinds), 4) else 0.0 end as entropy from t"""),
    Plan("a24_language_dominance", """
with n as (select source, lang, count(*) as n from {d} group by source, lang), r as (select *, row_number() over (partition by source order by n desc, lang) as r, sum(n) over (partition by source) as total from n)
select source, lang as dominant, n, round(n * 1.0 / total, 4) as share from r where r = 1"""),
    # a day's sessions are placed within it, after those of the days before: no window holds more than a day's sessions or all days
    Plan("o1_process_order", """
with f as (select session_id, min(day) as day from {t} group by session_id),
b as (select day, cast(sum(count(*)) over (order by day nulls last) as bigint) - count(*) as n_before from f group by day)
select f.session_id, cast(f.day as varchar(10)) as first_day, b.n_before + row_number() over (partition by f.day order by f.session_id) as place from f join b on b.day is not distinct from f.day"""),
]
