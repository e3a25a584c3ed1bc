"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landledger.llm import language, rules
from landledger.llm.archive import records_of_pages, resolve_revisits
from landledger.llm.collocations import collocations
from landledger.llm.decontaminate import benchmark_hits
from landledger.llm.infill import fill_in_middle, restored
from landledger.llm.line_dedup import drop_repeated_lines
from landledger.llm.near_dup import near_duplicates
from landledger.llm.packing import packed_documents
from landledger.llm.passages import repeated_passages
from landledger.llm.pii import KEY, pseudonymise
from landledger.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from landledger.llm.shards import slots_of, write_shards
from landledger.llm.shared import table
from landledger.llm.syncmers import neighbour_fingerprints

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce({0}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("""
with d as (select doc_id, """ + _WORDS.format("text") + """ as w from documents),
b as (select item_id::varchar as item_id, """ + _WORDS.format("text") + """ as w from benchmark),
windows as (
  select distinct item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as x, least(len(w), 10) as n
  from b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0
), places as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as x
  from d, (select distinct n from windows) m, unnest(range(1, len(w) - n + 2)) u(i)
), found as (select p.doc_id, p.i, p.n, w.item_id from places p join windows w using (x, n)),
hit as (select doc_id, count(distinct k) as n_hit from found, unnest(range(i, i + n)) u(k) group by doc_id),
named as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as names from found group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
  sha256(coalesce(n.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join hit h using (doc_id) left join named n using (doc_id)
""")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return benchmark_hits(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("""
with lines as (
  select d.doc_id, p.place, string_split(coalesce(d.text, ''), chr(10))[p.place] as line
  from documents d, unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) p(place)
), keys as (
  select *, """ + _LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))") + """ as key from lines
), held as (
  select key, count(distinct doc_id) n_docs, max(doc_id) largest from keys where length(key) >= 40 group by key
), judged as (
  select k.*, coalesce(h.n_docs >= 5 and k.doc_id <> h.largest, false) as gone from keys k left join held h using (key)
)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from judged group by doc_id
""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("""
with recursive w as (
  select doc_id, regexp_extract_all(""" + _LOWER.format("coalesce(text, '')") + """, '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as x
  from w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) u(i) where len(w) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (x) where a.doc_id <> b.doc_id group by 1, 2),
link as (
  select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)
), reach as (select a, b from link union select r.a, l.b from reach r join link l on l.a = r.b),
least as (select a, least(a, min(b)) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(l.component_id, d.doc_id) as component_id,
  coalesce(l.component_id, d.doc_id) = d.doc_id as kept
from documents d left join n using (doc_id) left join least l on l.a = d.doc_id
""")
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter("not held_out"))
    return language.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_COUNT = "(length({0}) - length(replace({0}, {1}, ''))) // {2}"
_BARS = " + ".join(_COUNT.format("line", _quoted(x), len(x)) for x in rules.BARS)
_PHRASES = " or ".join(f"contains(lower(line), {_quoted(x)})" for x in rules.BOILERPLATE)
_SYMBOLS = "length(regexp_replace({0}, '[^#*$%&|<>]', '', 'g'))"
_PLAIN_WORDS = "regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')"


@query(f"""
with d as (select doc_id, coalesce(text, '') as text, {_PLAIN_WORDS.format("coalesce(text, '')")} as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + {rules.REPEAT - 1}], ' ') as x
  from d, unnest(range(1, len(w) - {rules.REPEAT - 2})) u(i)
), twice as (select doc_id, x from windows group by 1, 2 having count(*) > 1),
repeats as (
  select doc_id, count(distinct k) as n from windows join twice using (doc_id, x), unnest(range(i, i + {rules.REPEAT})) u(k) group by 1
), lines as (
  select doc_id, p, string_split(text, chr(10))[p] as line from d, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(p)
), counted as (select *, len({_PLAIN_WORDS.format("line")}) as n from lines),
ruled as (
  select *, row_number() over (partition by doc_id, line order by p) as copy, n > 0 and (
    n < {rules.LONG_LINE} and not contains({_quoted(rules.MARKS)}, right(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1))
    or {_SYMBOLS.format("line")} * 100 > n * {rules.SYMBOL_PERCENT}
    or ({_BARS}) >= {rules.LEAST_BARS} and n <= ({_BARS} + 1) * {rules.BAR_WORDS + 1}
    or {_PHRASES}) as fails
  from counted
), totals as (
  select doc_id, count(*) filter (n > 0 and copy > 1) as n_dup_lines, coalesce(sum(n) filter (fails), 0) as lost from ruled group by 1
), base as (
  select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {_SYMBOLS.format("text")}::bigint as n_symbols,
    t.n_dup_lines::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words, t.lost
  from d join totals t using (doc_id) left join repeats r using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {rules.LEAST_WORDS} or 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words)
    and (n_words - lost) * 100 >= {rules.KEPT_PERCENT} * n_words as kept
from base
""")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("text")


@query()
def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


@query()
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


_CANONICAL = """
  regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), ':(80|443)$', ''), '^www\\.', '')
  || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '')
  || case when q = '' then '' else '?' || q end
"""


@query(f"""
with plain as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from pages
), asked as (
  select *, coalesce(array_to_string([x for x in string_split(regexp_extract(u, '\\?(.*)$', 1), '&')
    if x <> '' and not regexp_full_match(x, '(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*')], '&'), '') as q from plain
), named as (
  select page_id, {_CANONICAL} as canonical_url, '"' || md5(coalesce(html, '')) || '"' as tag, html, strlen(coalesce(html, '')) as n from asked
), pairs as (
  select a.page_id, a.canonical_url, a.tag, b.page_id as found, b.tag as old, b.html, b.n,
    row_number() over (partition by a.page_id order by b.page_id desc) as k
  from named a left join named b on a.canonical_url = b.canonical_url and b.page_id < a.page_id + 5000
)
select page_id * 2 as record_id, canonical_url, page_id as ts, null::bigint as refers_to, 'full' as state, n as n_chars_of_headers, md5(html) as body_md5
from (select page_id, canonical_url, html, length(tag) + 9 + length(page_id::varchar) + length(n::varchar) as n from named)
union all
select page_id * 2 + 1, canonical_url, page_id + 5000, found * 2,
  case when found is null then 'orphan' when tag = old then 'resolved' else 'stale' end,
  length(tag) + 2 + length((page_id + 5000)::varchar) + 10 + case when tag = old then 9 + length(n::varchar) else 3 end,
  case when tag = old then md5(html) end
from pairs where k = 1
""")
def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = resolve_revisits(records_of_pages(table(spark, sf_dir, "pages")))
    text = F.array_join(F.map_values("headers"), "")
    return records.select(
        "record_id", "canonical_url", "ts", "refers_to", "state", F.char_length(text).cast("long").alias("n_chars_of_headers"), F.md5("body").alias("body_md5")
    )


@query()
def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots_of(write_shards(table(spark, sf_dir, "documents")))


@query("""
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || doc_id::varchar) as h from documents
), drawn as (
  select doc_id, t, n, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or ('0x' || h[17:24])::bigint % 100 >= 90 then 'plain'
      when ('0x' || h[25:32])::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from d
), cut as (
  select *, left(t, least(c1, c2)) as p, substr(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) as m, substr(t, greatest(c1, c2) + 1) as s from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from cut
""")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


@query("""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(""" + _LOWER.format("coalesce(text, '')") + """, '[.,;:!?\x0A-\x0D]')) as piece from documents
), words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from words group by 1),
found as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, k, count(*) as f
  from words, unnest(range(1, 4)) s(k), unnest(range(1, len(w) - k + 2)) u(i) group by 1, 2, 3
), wanted as (select lang, phrase, k, f as a, string_split(phrase, ' ') as w from found where k > 1 and f >= 10),
cuts as (
  select c.lang, c.phrase, c.a, cut, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a) // (l.f::hugeint * r.f) as score
  from wanted c, unnest(range(1, c.k)) s(cut)
  join found l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:cut], ' ')
  join found r on r.lang = c.lang and r.phrase = array_to_string(c.w[cut + 1:], ' ')
), best as (select *, row_number() over (partition by lang, phrase order by score, cut) as place from cuts),
inside as (
  select lang, array_to_string(w[i:i + 1], ' ') as phrase, max(a) as longer from wanted, unnest(range(1, k)) u(i) where k = 3 group by 1, 2
), ranked as (
  select b.lang, b.phrase, b.a, b.l, b.r, b.score, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank
  from best b left join inside using (lang, phrase) where place = 1 and not coalesce(100 * longer >= 50 * b.a, false)
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked join total using (lang) where rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op13_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))
