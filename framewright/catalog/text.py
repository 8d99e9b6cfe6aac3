"""Registered queries: projections and text functions (inventory section 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.functions import symbols as Y
from framewright.functions import text as T
from framewright.operators import corpus as C
from framewright.operators.scans import number_rows
from framewright.plans import bindings as B


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_replace(expr: str, table) -> str:
    for old, new in table:
        expr = f"replace({expr}, {sql_text(old)}, {sql_text(new)})"
    return expr


#: The blanks of Unicode, written out for the other engine.
WIDE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def sql_collapse(expr: str) -> str:
    return (rf"regexp_replace(regexp_replace(regexp_replace({expr}, '~+', '~', 'g'), "
            rf"'[{WIDE}]+', ' ', 'g'), '\.+', '.', 'g')")


@query("T1_normalize_words", """SELECT doc_id, array_to_string(list_filter(string_split(
  regexp_replace(replace(lower(text), '-', ' '), '[^a-z'' ]', ' ', 'g'), ' '), lambda x: x <> ''), '|') AS words
FROM documents""")
def normalize_words(spark, sf):
    return B.table(spark, sf, "documents").select(
        "doc_id", F.array_join(T.normalize_words(F.col("text")), "|").alias("words"))


@query("T2_prepare_label", r"""SELECT doc_id, ' ' || CASE WHEN regexp_matches(t, '^\p{L}') THEN upper(t[1]) || t[2:] ELSE t END AS label
FROM (SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN '  ' || lower(text) ELSE text END, E' \n\t\r') AS t FROM documents)""")
def prepare_label(spark, sf):
    docs = B.table(spark, sf, "documents").withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("  "), F.lower("text"))).otherwise(F.col("text")))
    return docs.select("doc_id", T.prepare_label(F.col("text")).alias("label"))


@query("T3_mark_pauses", f"SELECT doc_id, {sql_collapse(sql_replace('text', Y.PAUSE_MARKS))} AS marked FROM documents")
def mark_pauses(spark, sf):
    return B.table(spark, sf, "documents").select("doc_id", Y.mark_pauses(F.col("text")).alias("marked"))


_BLANKED = [(". ", "。\u3000\u3000"), (", ", "，\u00a0 "), (" th", "\u2003\u2009th"), (" on", "\u202f\x1d\u205fon")]


@query("T3_mark_pauses_wide_blanks", f"SELECT doc_id, {sql_collapse(sql_replace(sql_replace('text', _BLANKED), Y.PAUSE_MARKS))} AS marked FROM documents")
def mark_pauses_wide(spark, sf):
    """Texts whose marks stand beside wide, narrow and non-breaking blanks."""
    col = F.col("text")
    for old, new in _BLANKED:
        col = F.replace(col, F.lit(old), F.lit(new))
    return B.table(spark, sf, "documents").select("doc_id", Y.mark_pauses(col).alias("marked"))


# Letters of the test texts stand in for phones, tones and marks.
PHONETIC = [("th", "θ"), ("on", "ʊ˩˥˩n"), ("er", "ɚ˥˨"), ("an", "ãn͡"), ("ng", "N"), ("ti", "tʰi"),
            ("ou", "oːu"), ("re", "ˈɹe"), ("le", "ɫe˧˧˩˥"), (". ", "... "), ("st", "st - ")]


def phonetic(spark, sf):
    col = F.col("text")
    for old, new in PHONETIC:
        col = F.replace(col, F.lit(old), F.lit(new))
    return B.spread(B.table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", col.alias("phones"))


def _phones_sql(keep: bool) -> str:
    table = Y.PHONE_MARKS + [(c, "") for c in Y.UNSUPPORTED] + ([] if keep else [(c, "") for c in Y.MODIFIER_MARKS])
    text = f"trim({sql_collapse(sql_replace(sql_replace('text', PHONETIC), table))}, '~')"
    if keep:
        # The contours of _CONTOURS, applied one after the other.
        text = f"list_reduce(list_prepend({text}, rules), lambda acc, r: replace(acc, split_part(r, '|', 1), split_part(r, '|', 2)))"
    return f"regexp_replace('~' || {text} || '~#', '~+', '~', 'g')"


# Tone letters by height: peaks of three, dips of three, then rising or level pairs, then falling pairs.
_CONTOURS = """WITH tones AS (SELECT unnest(['˥', '˦', '˧', '˨', '˩']) AS t, unnest([5, 4, 3, 2, 1]) AS h),
found AS (
  SELECT CASE WHEN a.h < b.h THEN 1 ELSE 2 END AS part, a.h AS x, b.h AS y, c.h AS z, a.t || b.t || c.t AS old,
    concat_ws(CASE WHEN a.h < b.h THEN '⮁' ELSE '⮃' END, a.t, b.t, c.t) AS new
  FROM tones a, tones b, tones c WHERE (a.h < b.h AND c.h < b.h) OR (a.h > b.h AND c.h > b.h)
  UNION ALL
  SELECT CASE WHEN a.h <= b.h THEN 3 ELSE 4 END, a.h, b.h, 0, a.t || b.t, concat_ws(CASE WHEN a.h <= b.h THEN '⭧' ELSE '⭨' END, a.t, b.t)
  FROM tones a, tones b),
contours AS (SELECT list(old || '|' || new ORDER BY part, x DESC, y DESC, z DESC) AS rules FROM found)"""


@query("T4_normalize_phones", f"{_CONTOURS} SELECT doc_id, {_phones_sql(True)} AS phones FROM documents, contours")
def normalize_phones(spark, sf):
    return phonetic(spark, sf).select("doc_id", Y.normalize_phones(F.col("phones")).alias("phones"))


@query("T4_normalize_phones_segments_only", f"SELECT doc_id, {_phones_sql(False)} AS phones FROM documents")
def normalize_phones_plain(spark, sf):
    return phonetic(spark, sf).select("doc_id", Y.normalize_phones(F.col("phones"), False).alias("phones"))


_IDS = "CASE c " + " ".join(f"WHEN {sql_text(s)} THEN {i}" for s, i in Y.aligner_ids().items()) + " END"


@query("T5_symbols_to_ids", f"""WITH p AS (SELECT doc_id, list_filter(string_split({_phones_sql(False)}, ''),
    lambda c: contains({sql_text(''.join(Y.aligner_ids()))}, c)) AS s FROM documents)
SELECT doc_id, array_to_string(list_concat([0], list_transform(s[2:len(s) - 2], lambda c: {_IDS}), [0]), ' ') AS ids FROM p""")
def symbols_to_ids(spark, sf):
    phones = phonetic(spark, sf).withColumn("phones", Y.normalize_phones(F.col("phones"), False))
    return phones.select("doc_id", F.array_join(Y.symbols_to_ids(F.col("phones")), " ").alias("ids"))


VOWELS = "aeiouəɪʊɛɔæ"


def feature_rows():
    """(symbol, value) rows by a simple rule; a real inventory is a table of the user."""
    marks = {"~": "silence", "#": "end of sentence", "?": "questionmark", "!": "exclamationmark",
             ".": "fullstop", " ": "word-boundary"}
    rows = []
    for i, s in enumerate(Y.SYMBOLS + " "):
        if s in marks:
            rows.append((s, marks[s]))
        else:
            rows += [(s, "phoneme"), (s, "vowel" if s in VOWELS else "consonant"),
                     (s, Y.FEATURES[22 + i % 14]), (s, "voiced" if i % 2 else "unvoiced")]
    return rows


def feature_table(spark):
    return Y.build_feature_table(spark.createDataFrame(feature_rows(), "symbol string, value string"), Y.FEATURE_INDEX)


def _features_sql() -> str:
    on: dict[str, set[int]] = {}
    for symbol, value in feature_rows():
        on.setdefault(symbol, set()).add(Y.FEATURE_INDEX[value])
    for places in on.values():
        if Y.FEATURE_INDEX["phoneme"] not in places:
            places.add(Y.FEATURE_INDEX["silence"])
    base = ", ".join("({}, '{}')".format(sql_text(s), "".join("1" if d in places else "0" for d in range(64)))
                     for s, places in on.items())
    ones = {0: ["stressed"]}
    for mark, names in Y.SETTING_MARKS.items():
        for name in names:
            ones.setdefault(Y.FEATURE_INDEX[name], []).append(f"contains(marks, '{mark}')")
    twos: dict[int, list[str]] = {}
    for mark, names in Y.TINTING_MARKS.items():
        free = [f"contains(marks, '{mark}')"] + [
            f"substring(bits, {Y.FEATURE_INDEX[n] + 1}, 1) <> '1'" for n in names]
        for name in names:
            twos.setdefault(Y.FEATURE_INDEX[name], []).append("(" + " AND ".join(free) + ")")

    def digit(d):
        value = f"substring(bits, {d + 1}, 1)"
        if d in twos:
            value = f"CASE WHEN {' OR '.join(twos[d])} THEN '2' ELSE {value} END"
        return f"CASE WHEN {' OR '.join(ones[d])} THEN '1' ELSE {value} END" if d in ones else value

    def chars(text):
        return "".join(f"\\x{{{ord(c):x}}}" for c in text)

    marks = "".join(Y.SETTING_MARKS) + "".join(Y.TINTING_MARKS)
    sym, mark, all_ = chars(Y.SYMBOLS + " "), chars(marks), chars(Y.SYMBOLS + " " + marks + Y.STRESS)
    return f"""{_CONTOURS}, p AS (SELECT doc_id, {_phones_sql(True)} AS t FROM documents, contours),
c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^{all_}]', '', 'g'), '{Y.STRESS}([{mark}]+)', '\\1{Y.STRESS}', 'g') AS t FROM p),
k AS (SELECT doc_id, regexp_extract_all(t, '{Y.STRESS}*[{sym}](?:{Y.STRESS}*[{mark}])*') AS parts FROM c),
u AS (SELECT doc_id, i - 1 AS pos, parts[i] AS part FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM k)),
w AS (SELECT doc_id, pos, starts_with(part, '{Y.STRESS}') AS stressed, substring(replace(part, '{Y.STRESS}', ''), 1, 1) AS symbol,
        substring(replace(part, '{Y.STRESS}', ''), 2) AS marks FROM u),
base(symbol, bits) AS (VALUES {base}),
f AS (SELECT symbol, marks, stressed, {' || '.join(digit(d) for d in range(64))} AS features
      FROM (SELECT DISTINCT symbol, marks, stressed FROM w) JOIN base USING (symbol))
SELECT symbol, features, count(*) AS n, sum(pos)::BIGINT AS places, count(DISTINCT doc_id) AS texts
FROM w JOIN f USING (symbol, marks, stressed) GROUP BY symbol, features"""


@query("T6_symbols_to_features", _features_sql())
def symbols_to_features(spark, sf):
    # One text becomes thousands of vectors, so the texts are spread first.
    phones = phonetic(spark, sf).repartition(spark.sparkContext.defaultParallelism, "doc_id")
    phones = phones.withColumn("phones", Y.normalize_phones(F.col("phones")))
    out = Y.symbols_to_features(phones, feature_table(spark), "doc_id", "phones", Y.SYMBOLS + " ")
    return out.groupBy("symbol", "features").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.countDistinct("doc_id").alias("texts")).select(
        "symbol", F.array_join("features", "").alias("features"), "n", "places", "texts")


@query("T7_build_feature_table", """WITH a AS (
  SELECT p_partkey AS symbol, unnest([p_name, p_type, CASE WHEN p_size % 2 = 0 THEN 'phoneme' ELSE 'mark' END]) AS value FROM part),
v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS idx FROM (
  SELECT DISTINCT value FROM a UNION SELECT 'silence')),
b AS (SELECT a.symbol, v.idx FROM a JOIN v USING (value)
      UNION SELECT symbol, (SELECT idx FROM v WHERE value = 'silence') FROM a GROUP BY symbol HAVING NOT bool_or(value = 'phoneme')),
w AS (SELECT max(idx) + 1 AS n FROM v)
SELECT symbol, array_to_string(list_transform(range(0, any_value(n)), lambda i: CASE WHEN list_contains(list(idx), i) THEN 1 ELSE 0 END), '') AS features
FROM b CROSS JOIN w GROUP BY symbol""")
def build_feature_table(spark, sf):
    part = B.table(spark, sf, "part")
    attrs = part.select(F.col("p_partkey").alias("symbol"), F.explode(F.array(
        "p_name", "p_type", F.when(F.col("p_size") % 2 == 0, "phoneme").otherwise("mark"))).alias("value"))
    values = attrs.select("value").unionByName(part.select(F.lit("silence").alias("value"))).distinct()
    index = number_rows(values, "value", out="idx").withColumn("idx", F.col("idx").cast("int"))
    out = Y.build_feature_table(attrs, index)
    return out.select("symbol", F.array_join("features", "").alias("features"))


@query("T8_result_name", f"""WITH {B.MANIFEST}
SELECT doc_id, doc_id || '_my_file_seed' || (doc_id % 5) || '_' || CASE doc_id % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' ELSE 'rand' END
  || '_' || replace(printf('adm%.3f', (doc_id % 8) / 7.0::DOUBLE), '.', 'p') AS name FROM manifest""")
def result_name(spark, sf):
    rows = B.manifest(spark, sf).withColumn("path", F.regexp_replace("path", r"\.wav$", " my file.wav"))
    gender = F.when(F.col("doc_id") % 3 == 0, "f").when(F.col("doc_id") % 3 == 1, "m")
    return rows.select("doc_id", C.result_name(
        F.col("path"), (F.col("doc_id") % 8) / 7.0, F.col("doc_id") % 5, gender).alias("name"))


@query("T9_select_corpus", "SELECT doc_id::VARCHAR AS doc_id, text, n_chars::DOUBLE AS n_chars FROM documents")
def select_corpus(spark, sf):
    return C.select_corpus(B.table(spark, sf, "documents"), ["lang", "source"], {"doc_id": "string", "n_chars": "double"})


_TOK = r"""tok AS (SELECT doc_id, doc_id % 16 AS batch, len(w) AS length, list_concat(
    [CASE WHEN doc_id % 16 < 8 OR doc_id % 3 = 0 THEN 1 ELSE 7 END], list_transform(w, lambda x: length(x)), [2, 2, 2]) AS ids
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS w FROM documents))"""


@query("T10_mask_labels", f"""WITH {_TOK},
m AS (SELECT doc_id, batch, list_transform(ids, lambda x, i: CASE WHEN i <= length + 2 THEN x ELSE -100 END) AS ids FROM tok),
b AS (SELECT batch, bool_and(ids[1] = 1) AS cut FROM m GROUP BY batch),
o AS (SELECT doc_id, CASE WHEN cut THEN ids[2:] ELSE ids END AS ids FROM m JOIN b USING (batch))
SELECT doc_id, array_to_string(ids, ' ') AS labels,
       array_to_string(list_transform(ids, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ' ') AS unmasked FROM o""")
def mask_labels(spark, sf):
    words = B.split_words(F.col("text"))
    first = F.when((F.col("doc_id") % 16 < 8) | (F.col("doc_id") % 3 == 0), 1).otherwise(7)
    rows = B.table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 16).alias("batch"), (F.size(words) + 2).alias("length"),
        F.concat(F.array(first), F.transform(words, lambda x: F.length(x)), F.array(F.lit(2), F.lit(2), F.lit(2))).alias("ids"))
    out = C.mask_labels(rows, 1, batch="batch")
    return out.select("doc_id", F.array_join("ids", " ").alias("labels"),
                      F.array_join(C.unmask_labels(F.col("ids"), 0), " ").alias("unmasked"))
