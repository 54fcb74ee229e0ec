"""DuckDB SQL for the queries of this subpackage that SQL can express; for the others the tests hold a brute-force version."""

from __future__ import annotations

from .quality_rules import RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quality_rules(alpha: float = 0.05, delta: float = 0.05) -> str:
    """The counts of every text, the binomial tests of every cutoff, and the verdicts."""
    tests = [(rule, stat, sign, cut) for rule, (stat, sign, cuts) in RULES.items() for cut in cuts]
    rate = alpha / len(RULES)
    counts = ", ".join(f"count(*) filter ({stat} {'>' if sign > 0 else '<'} {cut}::double) as k{i}" for i, (_, stat, sign, cut) in enumerate(tests))
    tail = f"(select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate}))) from range(k{{0}} + 1) as r(i))"
    passed = "case when k{0} <= n * " + str(rate) + " and " + tail + f" <= {delta} / ((select count(*) from counts) * {len(tests)}) then {{1}}::double end"
    cutoffs = ", ".join(f"coalesce({', '.join(passed.format(i, t[3]) for i, t in enumerate(tests) if t[0] == rule)}) as cut_{rule}" for rule in RULES)
    fails = " or ".join(f"coalesce({stat} {'>' if sign > 0 else '<'} cut_{rule}, false)" for rule, (stat, sign, _) in RULES.items())
    return rf"""
with words as (
  select doc_id, lang, coalesce(text, '') as text, {WORDS} as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents
), windows as (
  select doc_id, pos, w[pos:pos + 7] as win from (select doc_id, w, unnest(range(1, len(w) - 6)) as pos from words where len(w) >= 8)
), covered as (
  select doc_id, count(distinct p) as n_repeat_words from (
    select doc_id, unnest(range(pos, pos + 8)) as p from (select doc_id, pos, count(*) over (partition by doc_id, win) as times from windows) where times > 1
  ) group by doc_id
), base as (
  select doc_id, text, case when lang is null then '' else '=' || lang end as stratum, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from words left join covered using (doc_id)
), rated as (
  select *, n_symbols / greatest(word_chars, 1)::double as r_symbols, n_dup_lines / greatest(n_lines, 1)::double as r_dup_lines, n_repeat_words / greatest(n_words, 1)::double as r_repeats,
    word_chars / greatest(n_words, 1)::double as r_word_chars, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from base
), good as (
  select distinct on (stratum, text) * from rated where not base_failed and doc_id in (select doc_id from labels group by doc_id having max(quality) = 1)
), counts as (
  select stratum, count(*) as n, {counts} from good group by stratum
), cutoffs as (
  select stratum, {cutoffs} from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({fails}) as kept from rated left join cutoffs using (stratum)
"""


SUFFIX_DEDUP = """
with raw as (
  select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents
), windows as (
  select doc_id, p, substr(h, 2 * p + 1, 200) as s from (select doc_id, h, unnest(range(len(h) // 2 - 99)) as p from raw where len(h) >= 200)
), later as (
  select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as k from windows) where k > 1
), spans as (
  select doc_id, min(p) as s, max(p) + 100 as e from (
    select doc_id, p, sum(case when p > before + 100 or before is null then 1 else 0 end) over (partition by doc_id order by p) as g
    from (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from later)
  ) group by doc_id, g
), kept as (
  select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as b from spans
  union all select doc_id, max(e), 1000000000000 from spans group by doc_id
), texts as (
  select doc_id, string_agg(substr(h, 2 * a + 1, least(2 * (b - a), 4294967295)), '' order by a) as rest from kept join raw using (doc_id) group by doc_id
), sums as (
  select doc_id, sum(e - s) as n_removed, count(*) as n_spans from spans group by doc_id
)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256
from raw left join sums using (doc_id) left join texts using (doc_id)
"""

NGRAM_JOIN = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, case when len(w) < 4 then w else w[pos:pos + 3] end as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as pos from words where len(w) > 0)
), coded as (
  select doc_id, dense_rank() over (order by s) as s from shingles
), sizes as (
  select doc_id, count(*) as n from coded group by doc_id
), pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from coded a join coded b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)
), reach as (
  select a as doc_id, b as other from links union select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::bigint as component_id
from documents d left join sizes using (doc_id) left join (select doc_id, min(other) as m from reach group by doc_id) r using (doc_id)
"""

EMBEDDING_DEDUP = """
with recursive vectors as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit as (
  select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u, len(e) as d from vectors
), links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.d = b.d and a.vec_id <> b.vec_id where list_dot_product(a.u, b.u) >= 0.95
), reach as (
  select a as vec_id, b as other from links union select r.vec_id, l.b from reach r join links l on l.a = r.other
), counts as (
  select a as vec_id, count(*) as n from links group by a
), least_of as (
  select vec_id, min(other) as m from reach group by vec_id
)
select v.vec_id, coalesce(n, 0)::bigint as n_links, least(v.vec_id, coalesce(m, v.vec_id))::bigint as component_id, v.vec_id <= coalesce(m, v.vec_id) as kept
from embeddings v left join counts using (vec_id) left join least_of using (vec_id)
"""


def sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules(), "op2_suffix_dedup": SUFFIX_DEDUP, "op3_ngram_join": NGRAM_JOIN, "op7_embedding_dedup": EMBEDDING_DEDUP}
