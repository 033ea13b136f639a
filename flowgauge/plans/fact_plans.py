"""Plans of scalar facts: token counts, classes, fingerprints, predicates on commands and texts, set measures, repetition
scores, cues and lookups, each over whole feeds."""

from __future__ import annotations

from flowgauge.plans.catalog import Plan

#: What a turn's text says as sets of words, of names and numbers, and of action words, beside the turn of its role before.
SETS = """
t as (select session_id, seq, role, text, array_distinct(regexp_extract_all(lower(text), '[a-z_]{3,}', 0)) as words,
  array_distinct(regexp_extract_all(text, '[A-Z][a-z]+|[0-9]+', 0)) as names, array_distinct(regexp_extract_all(lower(text), '[a-z]+(ing|tion|ment|ieren|er)', 0)) as actions from {c}),
b as (select *, lag(words) over w as old_words, lag(names) over w as old_names, lag(actions) over w as old_actions, lag(seq) over w as old_seq from t window w as (partition by session_id, role order by seq)),
s as (select session_id, seq, role, old_seq, coalesce(size(array_intersect(words, old_words)) * 1.0 / nullif(size(array_union(words, old_words)), 0), 1.0) as lexical,
  coalesce(size(array_intersect(names, old_names)) * 1.0 / nullif(size(array_union(names, old_names)), 0), 1.0) as entity,
  coalesce(size(array_intersect(actions, old_actions)) * 1.0 / nullif(size(array_union(actions, old_actions)), 0), 0.0) as action from b where old_seq is not null)"""
#: The cosine of the counts of three-character grams in a turn and in the turn of its role before. Each count is dealt once,
#: to its own turn and to the next.
GRAMS = """
i as (select session_id, seq, lead(seq) over (partition by session_id, role order by seq) as next_seq, text from {c}),
g as (select session_id, seq, next_seq, gram, count(*) as k from (select session_id, seq, next_seq, substr(lower(text), cast(place as int), 3) as gram from (select session_id, seq, next_seq, text, explode(sequence(1, greatest(1, length(text) - 2))) as place from i) x) y group by session_id, seq, next_seq, gram),
h as (select session_id, case side when 0 then seq else next_seq end as seq, gram, sum(case side when 0 then k else 0 end) as k, sum(case side when 1 then k else 0 end) as old_k from (select *, explode(sequence(0, 1)) as side from g) x where side = 0 or next_seq is not null group by 1, 2, 3),
cosines as (select session_id, seq, sum(k * old_k) / (sqrt(sum(k * k)) * sqrt(sum(old_k * old_k))) as semantic from h group by session_id, seq having sum(old_k) > 0)"""
#: Paths as different shells write them.
PATHS = """
p as (select session_id, seq, path, case path % 3 when 0 then concat('C:/work/app', session_id % 4, '/src/m', path, '.py') when 1 then concat('/c/work/app', session_id % 4, '/src/m', path, '.ts') else concat('/c/work/lib/m', path, '.md') end as raw from {e} where path is not null),
n as (select session_id, seq, raw, case when raw like '/c/%' then concat('C:', substr(raw, 3)) else raw end as full_path from p),
r as (select *, regexp_extract(full_path, '^([A-Z]:/[a-z]+/[a-z0-9]+)/', 1) as root from n),
v as (select session_id, root, row_number() over (partition by session_id order by count(*) desc, root) as place from r group by session_id, root)"""
#: Cues of reasoning phases and their weights.
CUES = {"near_answer": "(therefore|so the|finally|result)", "confirming": "(check|verify|confirm|indeed)", "exploring": "(maybe|perhaps|could|alternatively|in the)", "filler": "(well|okay|hmm|let me|than)"}
SIGNAL_CUES = ", ".join(f"regexp_count(lower(text), '{p}') as {n}" for n, p in CUES.items())
#: Words of questions: sentences end at . ! or ? before white space, and at line ends; a point inside a word ends none.
QUESTIONS = """
with g as (select session_id, seq, concat({clean}, chr(10)) as text from {{c}} where role = 'user'),
q as (select session_id, seq, {each}(regexp_extract_all(text, '[^.!?\\r\\n]*[.!?\\r\\n][ \\t\\r\\n]?', 0)) as sentence from g),
w as (select distinct session_id, seq, word from (select session_id, seq, {each}(regexp_extract_all(sentence, '[a-z]{{4,}}', 0)) as word from q {words}) x)
select session_id, seq, count(*) as words, min(word) as first_word, max(word) as last_word from w group by session_id, seq"""

PLANS = [
    Plan("p2_quarter_tokens", "select session_id, seq, greatest(cast(1 as bigint), cast(floor(length(text) / 4.0) as bigint)) as tokens from {c}"),
    Plan("p3_phase_tokens", "select session_id, seq, cast(bround(length(text) / case role when 'assistant' then 3.2 else 4.0 end, 0) as bigint) as tokens from {c}"),
    Plan("p4_calibrated_tokens", """
with n as (select session_id, seq, length(text) as chars, size(regexp_extract_all(text, '[{}();=<>_/]', 0)) as code from {c}),
d as (select *, case when chars > 0 then code * 1.0 / chars else 0.0 end as density from n)
select session_id, seq, greatest(cast(1 as bigint), cast(floor(chars / case when density >= 0.03 then 3.2 else 4.0 end) as bigint)) as tokens, round(case when chars = 0 then 0.0 when density >= 0.03 then 0.7 else 0.8 end, 4) as confidence from d"""),
    Plan("p6_block_phase", "select session_id, seq, case kind when 'read' then 'reasoning' when 'edit' then 'tool_use' when 'check' then 'tool_use' else 'generation' end as phase from {e}"),
    Plan("p8_event_class", "select class, count(*) as events, cast(sum(tokens) as bigint) as tokens from (select tokens, case when kind = 'prompt' then 'user' when outcome is not null then 'lifecycle' when kind = 'edit' then 'generated' else 'tool' end as class from {e}) x group by class"),
    Plan("p17_output_fingerprint", "select session_id, seq, substr(sha2(regexp_replace(trim(text), '[0-9]+([.][0-9]+)?(ms|s)?', '#'), 256), 1, 16) as fingerprint from {c}"),
    Plan("p20_defined_names", """select doc_id, array_join(array_sort(array_distinct(regexp_extract_all(text, '(class|function|def|const|let|var|password|token)[ =:"]+([A-Za-z0-9_]{3,})', 2))), ' ') as names from {d} where size(regexp_extract_all(text, '(class|function|def|const|let|var|password|token)[ =:"]+([A-Za-z0-9_]{3,})', 2)) > 0"""),
    Plan("p21_source_lines", "select doc_id, size(array_distinct(filter(transform(split(text, chr(10)), x -> trim(x)), x -> x <> ''))) as lines, size(split(text, chr(10))) as raw_lines from {d} where text is not null"),
    Plan("p23_question_words", QUESTIONS.format(clean=r"regexp_replace(lower(text), '\\b[.]\\b', ' ')", each="explode", words="where sentence rlike '[?][ \\t\\r\\n]$'"),
         duck=QUESTIONS.format(clean=r"regexp_replace(lower(text), '\b[.]\b', ' ', 'g')", each="unnest", words=r"where regexp_matches(sentence, '[?][ \t\r\n]$')")),
    Plan("p24_path_predicates", f"with {PATHS} select session_id, seq, full_path like '%.md' as is_doc, full_path like '%/src/%' as in_source, full_path like 'C:/work/lib/%' as outside from n"),
    Plan("p26_change_terms", f"with {SETS} select session_id, seq, size(array_except(words, old_words)) as added, size(array_except(old_words, words)) as removed from b where old_seq is not null"),
    Plan("p35_text_repetition", f"with {GRAMS}, {SETS} select s.session_id, s.seq, round((0.82 * x.semantic + 0.18 * (0.45 * s.lexical + 0.30 * s.entity + 0.25 * s.action)) * (1.0 - 0.30 * (1.0 - s.lexical)), 4) as score from s join cosines x on x.session_id = s.session_id and x.seq = s.seq"),
    Plan("p36_tool_repetition", """
with c as (select session_id, seq, kind, path, tokens, lag(kind) over w as old_kind, lag(path) over w as old_path, lag(tokens) over w as old_tokens from {e} where kind <> 'prompt' window w as (partition by session_id order by seq)),
s as (select session_id, seq, kind = old_kind and path = old_path and tokens = old_tokens as same, case when kind <> old_kind then 1.0 when path <> old_path then 0.25 when tokens <> old_tokens then 0.25 else 0.0 end as novelty, case when kind = old_kind then 1.0 else 0.0 end as act, case when path = old_path then 1.0 else 0.0 end as ent from c where old_kind is not null)
select session_id, seq, round(novelty, 4) as novelty, round(case when same then 1.0 else (0.45 * act + 0.15 * ent + 0.10 * ent + 0.30 * act) * (1.0 - 0.85 * novelty) end, 4) as score from s"""),
    Plan("p37_set_overlaps", f"with {SETS} select session_id, seq, round(lexical, 4) as lexical, round(entity, 4) as entity, round(action, 4) as action from s"),
    Plan("p38_trigram_cosine", f"with {GRAMS} select session_id, seq, round(semantic, 4) as score from cosines"),
    Plan("p41_budget", """
with u as (select session_id, sum(tokens) as used, count(*) as turns, avg(tokens) as mean from {t} group by session_id),
k as (select *, case when turns <= 5 then 'small' when turns <= 12 then 'medium' else 'large' end as tier from u),
h as (select tier, percentile(used, 0.75) as typical from k group by tier)
select k.session_id, k.tier, case k.tier when 'large' then 'strong' else 'fast' end as model, case k.tier when 'small' then 1024 when 'medium' then 4096 else 16384 end as thinking, round(greatest(h.typical, 1000.0), 4) as total, k.used > h.typical as over from k join h on h.tier = k.tier"""),
    Plan("p42_reasoning_phase", f"""
with n as (select session_id, seq, {SIGNAL_CUES} from {{c}} where role = 'assistant'),
w as (select *, 1.0 * near_answer as a, 0.8 * confirming as b, 0.6 * exploring as x, 0.4 * filler as y from n)
select session_id, seq, case when a + b + x + y = 0.0 then 'ambiguous' when a >= b and a >= x and a >= y then 'near_answer' when b >= x and b >= y then 'confirming' when x >= y then 'exploring' else 'filler' end as phase from w"""),
    Plan("p44_language_of_path", f"with {PATHS}, x as (select regexp_extract(full_path, '[.]([a-z]+)$', 1) as extension, session_id from n) select case extension when 'py' then 'Python' when 'ts' then 'TypeScript' when 'md' then 'Markdown' else 'other' end as language, count(*) as events, count(distinct session_id) as sessions from x group by 1"),
    Plan("p46_session_roots", f"with {PATHS} select r.session_id, r.seq, case when r.root = v.root then substr(r.full_path, cast(length(v.root) + 2 as int)) end as relative, v.root as root from r join v on v.session_id = r.session_id and v.place = 1"),
    Plan("a2_phase_weights", """
with w as (select source, count(*) * 1.0 / sum(count(*)) over () as weight from {j} group by source)
select count(*) as phases, min(weight) >= 0 as none_negative, abs(sum(weight) - 1.0) <= 0.01 as sums_to_one from w"""),
    Plan("u3_word_sets", f"with {SETS} select session_id, seq, size(array_intersect(words, old_words)) as shared, size(array_except(words, old_words)) as fresh, size(array_union(words, old_words)) as together from b where old_seq is not null"),
    Plan("w25_explanation_codes", f"""
with {GRAMS}, {SETS}, x as (select s.*, m.semantic, size(regexp_extract_all(i.text, '[^ ]+', 0)) as n from s join cosines m on m.session_id = s.session_id and m.seq = s.seq join i on i.session_id = s.session_id and i.seq = s.seq)
select session_id, seq, case when semantic >= 0.9 then 'repetition' when n < 5 then 'low_information' when lexical < 0.02 then 'low_relevance' when semantic < 0.5 then 'novel' else 'aligned' end as code, round(semantic, 4) as similarity from x"""),
    Plan("w46_dominance_tiers", """
with c as (select source, lang, case when length(text) >= 1000 then 1 when length(text) >= 200 then 2 else 3 end as tier, count(*) as n from {d} where text is not null group by 1, 2, 3),
f as (select source, min(tier) as tier from c group by source)
select c.source, c.lang, c.tier, c.n, row_number() over (partition by c.source order by c.n desc, c.lang) as place from c join f on f.source = c.source and f.tier = c.tier"""),
]
