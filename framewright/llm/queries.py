"""The queries ``opN_<name>`` over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, dual_tree, exact_dedup, hidden_markov, host_rules, html_text, language, line_dedup, near_dedup, packing, quality,
    suffix_dedup, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(name: str, parts: int) -> Column:
    """The fold of an id: crc32 of its text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def held_out(name: str, parts: int, part: int) -> Column:
    return F.coalesce(fold(name, parts) == part, F.lit(False))


_OP1 = r"""
with bodies as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
starts as (select doc_id, p, md5(substr(x, 2 * p + 1, 200)) as w from bodies, unnest(range(0, (length(x) // 2 - 99)::bigint)) as s(p) where length(x) >= 200),
later as (select doc_id, p from starts qualify row_number() over (partition by w order by doc_id, p) > 1),
marks as (select doc_id, p, p > 1 + 99 + max(p) over (partition by doc_id order by p rows between unbounded preceding and 1 preceding) as fresh from later),
runs as (select doc_id, p, sum((fresh is null or fresh)::int) over (partition by doc_id order by p) as run from marks),
spans as (select doc_id, min(p) as a, max(p) + 100 as b from runs group by doc_id, run),
gaps as (
  select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as g0, a as g1 from spans
  union all select doc_id, max(b), null from spans group by doc_id
), kept as (
  select g.doc_id, string_agg(substr(x, 2 * g0 + 1, coalesce(2 * g1, length(x)) - 2 * g0), '' order by g0) as k
  from gaps g join bodies using (doc_id) group by g.doc_id
), sizes as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from spans group by doc_id)
select doc_id, length(x)::bigint // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k, x))) as kept_sha256
from bodies left join sizes using (doc_id) left join kept using (doc_id)
"""


@query("op1_suffix_dedup", _OP1)
def op1(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


_OP2 = r"""
with item_lists as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark where text is not null
), grams as (
  select item_id, least(len(ws), 13) as k, array_to_string(ws[p : p + least(len(ws), 13) - 1], ' ') as gram
  from item_lists, unnest(generate_series(1, greatest(len(ws) - 12, 1))) as s(p) where len(ws) > 0
), doc_lists as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), sizes as (select distinct k from grams),
doc_grams as (
  select doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') as gram
  from doc_lists, sizes, unnest(generate_series(1, len(ws) - k + 1)) as s(p) where len(ws) >= k
), found as (
  select d.doc_id, d.k, d.p, g.item_id from doc_grams d join grams g on d.k = g.k and d.gram = g.gram
), hit as (
  select doc_id, count(distinct q) as n_hit from found, unnest(generate_series(p, p + k - 1)) as s(q) group by doc_id
), listed as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from found where item_id is not null) group by doc_id
)
select l.doc_id, len(l.ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(l.ws) as contaminated
from doc_lists l left join hit using (doc_id) left join listed using (doc_id)
"""


@query("op2_decontaminate", _OP2)
def op2(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs, items, keep=["doc_id"])


_OP3 = r"""
with lines as (
  select doc_id, i, list_element(ls, i) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
    unnest(generate_series(1, len(ls))) as s(i)
), keyed as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), gone as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select k.doc_id, count(*)::bigint as n_lines, count(g.key)::bigint as n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) order by k.i) filter (where g.key is null), '')) as kept_sha256
from keyed k left join gone g on k.key = g.key and k.doc_id <> g.keeper group by k.doc_id
"""


@query("op3_line_dedup", _OP3)
def op3(spark, sf_dir):
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"], digest=True)


@query("op4_language_codes")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out("id", 3, 1))
    return language.predict(docs, model, keep=["doc_id"]).withColumn("held_out", held_out("doc_id", 3, 1)).drop("ambiguous")


# The test pages have one plain article each, which SQL can cut out without a tree.
_OP5 = r"""
with parts as (
  select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') as ps from pages
), cells as (
  select page_id, url, i, trim(regexp_replace(replace(replace(replace(replace(
    regexp_replace(replace(list_element(ps, i), '<br>', ' '), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[\s\x{A0}]+', ' ', 'g')) as cell
  from parts, unnest(generate_series(1, len(ps))) as s(i)
), texts as (
  select page_id, url, coalesce(string_agg(cell, chr(10) order by i) filter (where cell <> ''), '') as text from cells group by page_id, url
)
select page_id, url, text, length(text)::bigint as n_chars from texts
"""


@query("op5_html_text", _OP5)
def op5(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


_OP6 = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') as ws from documents
), grams as (
  select doc_id, p, array_to_string(ws[p : p + 7], ' ') as g from d, unnest(generate_series(1, len(ws) - 7)) as s(p) where len(ws) >= 8
), twice as (select doc_id, g from grams group by all having count(*) > 1),
covered as (
  select doc_id, count(distinct q) as n_repeat_words from grams join twice using (doc_id, g), unnest(generate_series(p, p + 7)) as s(q) group by doc_id
), lines as (
  select doc_id, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select doc_id, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^ 	-
]') group by doc_id
), m as (
  select d.doc_id, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[ 	-
]+', '', 'g'))::bigint as word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_lines, 0) as n_lines
  from d left join covered using (doc_id) left join lines using (doc_id)
), long as (
  select source, rule, bad from m, unnest([
    {'rule': 1, 'bad': n_words < 20}, {'rule': 2, 'bad': 100 * n_repeat_words > 30 * n_words}, {'rule': 3, 'bad': 10 * n_symbols > n_words},
    {'rule': 4, 'bad': 3 * n_dup_lines > n_lines}, {'rule': 5, 'bad': n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)}]) as u(x),
    unnest([x.rule]) as r(rule), unnest([x.bad]) as b(bad)
), hosts as (select source, rule, count(*)::double as n, count(*) filter (where bad)::double as k from long group by all),
moments as (select rule, sum(k) / sum(n) as mean, var_pop(k / n) as v from hosts group by rule),
prior as (select rule, mean, least(1000, greatest(1, case when v > 0 then mean * (1 - mean) / v - 1 else 1 end)) as strength from moments),
verdict as (select source, bool_or((k + mean * strength) / (n + strength) > 0.5) as host_failed from hosts join prior using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not host_failed as kept
from m join verdict on m.source is not distinct from verdict.source
"""


@query("op6_host_rules", _OP6)
def op6(spark, sf_dir):
    return host_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("n_lines", "host_failed")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op7_packing")
def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_hidden_markov")
def op8(spark, sf_dir):
    scored = hidden_markov.score_texts(table(spark, sf_dir, "documents"), ~held_out("id", 7, 2) & F.col("id").isNotNull())
    return scored.withColumn("held_out", held_out("doc_id", 7, 2))


@query("op9_dart_minhash")
def op9(spark, sf_dir):
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality.train(docs, labels, ~held_out("id", 4, 2))
    scored = quality.score(docs, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


_OP11 = r"""
with terms as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark
), sizes as (select count(*) as nd, sum(len(ws))::bigint as l from terms where len(ws) > 0),
counts as (select r, doc_id, term, len(ws) as n, count(*) as tf from (select r, doc_id, ws, unnest(ws) as term from terms) group by all),
weights as (select term, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)::double))::bigint as w from counts, sizes group by term, nd),
scored as (
  select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nd) // l)))))::bigint as score
  from wanted join counts using (term) join weights using (term), sizes group by item_id, r, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""


@query("op11_dual_tree_search", _OP11)
def op11(spark, sf_dir):
    return dual_tree.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_OP12 = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n_chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents
)
select doc_id, first_value(doc_id) over best as keep_id, count(*) over (partition by text_sha256) as group_size, row_number() over best = 1 as kept, text_sha256
from d window best as (partition by text_sha256 order by n_chars desc, doc_id)
"""


@query("op12_exact_dedup", _OP12)
def op12(spark, sf_dir):
    marked = exact_dedup.mark_copies(table(spark, sf_dir, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op13_whitening")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit_whitening(rows))
