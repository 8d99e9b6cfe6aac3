"""Phonetic text: pause marks, phone-string cleaning, symbol ids and feature vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.text import replace_in_order
from framewright.functions.vectors import let
from framewright.operators.scans import bounded_broadcast
from framewright.session import materialize

# ---------------------------------------------------------------- fixed values
# Ordered replacements (from, to); the order is part of the meaning.
PAUSE_MARKS = [
    ("。", "~"), ("，", "~"), ("【", "~"), ("】", "~"), ("、", "~"), ("‥", "~"), ("؟", "~"), ("،", "~"),
    ("“", "~"), ("”", "~"), ("؛", "~"), ("《", "~"), ("》", "~"), ("？", "~"), ("！", "~"),
    (" ：", "~"), (" ；", "~"), ("－", "~"), ("·", " "), ("`", ""),
    ('"', "~"), (" - ", "~ "), ("- ", "~ "), ("-", ""), ("…", "~"), (":", "~"), (";", "~"), (",", "~"),
]
PHONE_MARKS = [
    ("。", "."), ("，", ","), ("【", '"'), ("】", '"'), ("、", ","), ("‥", "…"), ("؟", "?"), ("،", ","),
    ("“", '"'), ("”", '"'), ("؛", ","), ("《", '"'), ("》", '"'), ("？", "?"), ("！", "!"),
    (" ：", ":"), (" ；", ";"), ("－", "-"), ("·", " "),
    ("/", " "), ("—", ""), ("(", "~"), (")", "~"), ("...", "…"), ("\n", ", "), ("\t", " "),
    ("¡", ""), ("¿", ""), ("«", '"'), ("»", '"'),
    ("N", "ŋ"), ("ɫ", "l"), ("ɚ", "ə"), ("g", "ɡ"), ("ε", "e"), ("ʦ", "ts"), ("ˤ", "ˁ"), ("ᵻ", "ɨ"),
    ("ɧ", "ç"), ("ɥ", "j"), ("ɬ", "s"), ("ɮ", "z"), ("ɺ", "ɾ"), ("ʲ", "j"),
    ("ˌ", ""), ("̋", "˥"), ("́", "˦"), ("̄", "˧"), ("̀", "˨"), ("̏", "˩"),
    ("̂", "⭨"), ("̌", "⭧"), ("꜖", "˩"), ("꜕", "˨"), ("꜔", "˧"), ("꜓", "˦"), ("꜒", "˥"),
    ('"', "~"), (" - ", "~ "), ("- ", "~ "), ("-", ""), ("…", "."), (":", "~"), (";", "~"), (",", "~"),
]
UNSUPPORTED = "̙̯̤̩̠̟ꜜ̽|•↘‖‿ᷝᷠ̚↗ꜛ̻̘̺͡"
# Marks removed when only the segmental units are wanted.
MODIFIER_MARKS = (
    "ˈːˑ̆˥˦˧˨˩̌̂⭧⭨⮃⮁̧̃ʷʰˠˁˀʼ̹̞̪̬̝̰̜̥̈")
TONES = "˥˦˧˨˩"  # from very high to very low
RISING, FALLING, PEAKING, DIPPING = "⭧", "⭨", "⮁", "⮃"

SYMBOLS = ("~#?!ǃ.ɜəaðɛɪŋɔɒɾʃθʊʌʒæbʔdefghijklmnɳopɡɹrstuvwxzʀøçɐœyʏɑcɲɣʎβʝɟqɕɭɵʑʋʁɨʂɓʙɗɖχʛʟɽɢɠǂɦǁĩʍʕɻʄũɤɶõʡ"
           "ʈʜɱɯǀɸʘʐɰɘħɞʉɴʢѵ")
SILENT_MARKS = "#?!."
ALIGNER_MARKS = {" ": 0, "~": 1, "?": 2, "!": 3, ".": 4, "#": 5}

FEATURES = [
    "stressed", "very-high-tone", "high-tone", "mid-tone", "low-tone", "very-low-tone", "rising-tone",
    "falling-tone", "peaking-tone", "dipping-tone", "lengthened", "half-length", "shortened",
    "consonant", "vowel", "phoneme",
    "silence", "end of sentence", "questionmark", "exclamationmark", "fullstop", "word-boundary",
    "dental", "postalveolar", "velar", "palatal", "glottal", "uvular", "labiodental", "labial-velar",
    "alveolar", "bilabial", "alveolopalatal", "retroflex", "pharyngal", "epiglottal",
    "central", "back", "front_central", "front", "central_back",
    "mid", "close-mid", "close", "open-mid", "close_close-mid", "open-mid_open", "open",
    "rounded", "unrounded",
    "plosive", "nasal", "approximant", "trill", "flap", "fricative", "lateral-approximant", "implosive",
    "vibrant", "click", "ejective",
    "aspirated", "unvoiced", "voiced",
]
STRESS = "ˈ"
# Marks that set features of the symbol before them to 1.
SETTING_MARKS = {
    "ː": ["lengthened"], "ˑ": ["half-length"], "̆": ["shortened"],
    "˥": ["very-high-tone"], "˦": ["high-tone"], "˧": ["mid-tone"], "˨": ["low-tone"], "˩": ["very-low-tone"],
    "⭧": ["rising-tone"], "⭨": ["falling-tone"], "⮁": ["peaking-tone"], "⮃": ["dipping-tone"],
}
# Marks that set features to 2, unless one of them is 1 already.
TINTING_MARKS = {
    "̃": ["nasal"], "̧": ["palatal"], "ʷ": ["labial-velar"], "ʰ": ["aspirated"], "ˠ": ["velar"],
    "ˁ": ["pharyngal"], "ˀ": ["glottal"], "ʼ": ["ejective"], "̹": ["rounded"], "̞": ["open"],
    "̪": ["dental"], "̬": ["voiced"], "̝": ["close"], "̰": ["glottal", "epiglottal"],
    "̈": ["central"], "̜": ["unrounded"], "̥": ["unvoiced"],
}
# ---------------------------------------------------------------- end of fixed values

FEATURE_INDEX = {name: i for i, name in enumerate(FEATURES)}


def ctc_ids() -> dict[str, int]:
    """Symbol ids in inventory order; punctuation counts as silence."""
    ids = {s: i for i, s in enumerate(SYMBOLS)}
    return {s: ids["~"] if s in SILENT_MARKS else i for s, i in ids.items()}


def aligner_ids() -> dict[str, int]:
    """Ids with the word boundary at 0 and the marks at fixed places."""
    return {**ctc_ids(), **ALIGNER_MARKS}


#: Fixed value: what counts as a blank in running text, the wide blanks beside East Asian marks included.
BLANKS = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _collapse(col: Column) -> Column:
    for pattern, mark in (("~+", "~"), (f"[{BLANKS}]+", " "), (r"\.+", ".")):
        col = F.regexp_replace(col, pattern, mark)
    return col


def mark_pauses(col: Column) -> Column:
    """Punctuation to pause marks; runs of marks, blanks and dots become one."""
    return _collapse(replace_in_order(col, PAUSE_MARKS))


def tone_contours() -> list[tuple[str, str]]:
    """Tone sequences and their forms with a contour mark between the tones.

    Three-tone peaks, then three-tone dips, then rising (or level) and falling pairs.
    """
    height = {t: -i for i, t in enumerate(TONES)}
    pairs, triples = list(product(TONES, repeat=2)), list(product(TONES, repeat=3))
    peaks = [t for t in triples if height[t[0]] < height[t[1]] > height[t[2]]]
    dips = [t for t in triples if height[t[0]] > height[t[1]] < height[t[2]]]
    falls = [p for p in pairs if height[p[0]] > height[p[1]]]
    rises = [p for p in pairs if height[p[0]] <= height[p[1]]]
    groups = ((PEAKING, peaks), (DIPPING, dips), (RISING, rises), (FALLING, falls))
    return [("".join(t), mark.join(t)) for mark, group in groups for t in group]


def _each(fn: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """``fn`` on every text, in Arrow batches; null stays null, bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        return pa.array([None if t is None else fn(t.decode("utf-8", "replace")) for t in raw.to_pylist()],
                        {"string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}[kind])

    return run


def _cleaner(table: list[tuple[str, str]], contours: list[tuple[str, str]]) -> Callable[[str], str]:
    toned, known = re.compile(f"[{TONES}]{{2,}}"), {}

    def contour(found):
        run = found[0]
        if run not in known:
            marked = run
            for old, new in contours:
                marked = marked.replace(old, new)
            if len(known) >= 4096:
                known.clear()
            known[run] = marked
        return known[run]

    def clean(text):
        for old, new in table:
            text = text.replace(old, new)
        text = re.sub("~~+", "~", text)
        inner = " ".join(text.split())  # its blanks are those of BLANKS
        if text[:1].isspace():
            inner = " " + inner
        if inner.strip() and text[-1:].isspace():
            inner += " "
        text = re.sub(r"\.\.+", ".", inner).strip("~")
        if contours:  # they live inside runs of tone letters
            text = toned.sub(contour, text)
        return re.sub("~~+", "~", f"~{text}~#")

    return clean


def normalize_phones(col: Column, keep_modifiers: bool = True) -> Column:
    """Clean a phone string and frame it with pause and end marks."""
    table = PHONE_MARKS + [(c, "") for c in UNSUPPORTED]
    if not keep_modifiers:
        table = table + [(c, "") for c in MODIFIER_MARKS]
    return _each(_cleaner(table, tone_contours() if keep_modifiers else []), "string")(col)


def symbols_to_ids(col: Column, inventory: Mapping[str, int] | None = None) -> Column:
    """Ids of a framed symbol string: unknown symbols and the frame marks go, 0 stands at both ends."""
    inventory = dict(aligner_ids() if inventory is None else inventory)

    def ids(text):
        known = [i for i in map(inventory.get, text) if i is not None]
        return [0, *known[1:max(len(known) - 2, 1)], 0]

    return _each(ids, "array<int>")(col)


def build_feature_table(attributes: DataFrame, index: DataFrame | Mapping[str, int], size: int | None = None,
                        phoneme: str = "phoneme", silence: str = "silence") -> DataFrame:
    """symbol, features: one-hot vectors from rows (symbol, value) and a value index.

    Whatever is not a phoneme also gets the silence bit.
    """
    if isinstance(index, Mapping):
        size = size or len(index)
        index = attributes.sparkSession.createDataFrame(list(index.items()), "value string, idx int")
    bits = attributes.join(index, "value").groupBy("symbol").agg(
        F.collect_set("idx").alias("_on"), F.max(F.col("value") == phoneme).alias("_speech"))
    if size is None:
        size = index.agg(F.max("idx")).first()[0] + 1
    quiet = F.lit(index.filter(F.col("value") == silence).select("idx").first()[0])
    on = F.when(F.col("_speech"), F.col("_on")).otherwise(F.array_append("_on", quiet))
    return bits.select(
        "symbol", let(
            lambda s: F.transform(F.sequence(F.lit(0), F.lit(size - 1)),
                                  lambda i: F.when(F.array_contains(s["on"], i), 1).otherwise(0)),
            on=on).alias("features"))


def symbols_to_features(texts: DataFrame, table: DataFrame, key: str, col: str,
                        symbols: str, limit_bytes: int = 64 << 20) -> DataFrame:
    """key, pos, symbol, features: one vector per known symbol, with its marks applied.

    ``symbols`` lists what ``table`` (symbol, features) knows. A regular
    expression cuts the text into symbols with their trailing marks; a stress
    mark works on the next symbol and is moved right before it. A symbol with its marks
    travels as one number; each number gets its vector once, and the rows look it up.
    """
    marks = "".join(SETTING_MARKS) + "".join(TINTING_MARKS)
    symbols = "".join(s for s in symbols if s not in marks + STRESS)
    place, known = {m: 1 << i + 1 for i, m in enumerate(marks)}, {}
    place[STRESS] = 0

    def char_class(chars: str) -> str:
        return "".join(re.escape(c) for c in chars)

    sym, mark = f"[{char_class(symbols)}]", f"[{char_class(marks)}]"
    unknown, late = re.compile(f"[^{char_class(symbols + marks + STRESS)}]+"), re.compile(f"{STRESS}({mark}+)")
    part = re.compile(f"{STRESS}*{sym}(?:{STRESS}*{mark})*")

    def code(found):
        """The symbol's code point, a bit per mark, and a bit for a stress before it."""
        bare = found.lstrip(STRESS)
        number = ord(bare[0]) << len(marks) + 1 | (bare != found)
        for m in bare[1:]:
            number |= place[m]
        if len(known) < 65536:
            known[found] = number
        return number

    def parts(text):
        return [known.get(p) or code(p) for p in part.findall(late.sub(rf"\1{STRESS}", unknown.sub("", text)))]

    cut = materialize(texts.select(key, _each(parts, "array<bigint>")(F.col(col)).alias("_parts")), "symbol-parts")
    rows = cut.select(F.explode("_parts").alias("_part")).distinct().withColumn("_point", F.shiftright("_part", len(marks) + 1))
    table = table.filter(F.length("symbol") == 1).withColumn("_point", F.ascii("symbol").cast("bigint"))
    rows = rows.join(bounded_broadcast(table, F.size("features") * 4 + 64, limit_bytes), "_point")
    stressed = F.col("_part").bitwiseAND(1) != 0

    def has(mark):
        return F.col("_part").bitwiseAND(F.lit(place[mark])) != 0

    def bits(terms):
        total = F.lit(0).cast("bigint")
        for cond, name in terms:
            total = total.bitwiseOR(F.when(
                cond, F.shiftleft(F.lit(1).cast("bigint"), FEATURE_INDEX[name])).otherwise(0))
        return total

    ones = [(stressed, "stressed")] + [(has(m), f) for m, fs in SETTING_MARKS.items() for f in fs]
    twos = []
    for mark, names in TINTING_MARKS.items():
        free = has(mark)
        for name in names:
            free = free & (F.col("features")[FEATURE_INDEX[name]] != 1)
        twos += [(free, name) for name in names]
    changed = let(
        lambda s: F.transform(s["v"], lambda v, i: F.when(F.getbit(s["one"], i) == 1, 1).when(
            F.getbit(s["two"], i) == 1, 2).otherwise(v)),
        v=F.col("features"), one=bits(ones), two=bits(twos))
    marked = F.col("_part").bitwiseAND(F.lit((1 << len(marks) + 1) - 1)) != 0
    looks = materialize(rows.select(
        "_part", "symbol", F.when(marked, changed).otherwise(F.col("features")).alias("features")), "symbol-vectors")
    looks = bounded_broadcast(looks, F.size("features") * 4 + 128, limit_bytes)
    return cut.select(key, F.posexplode("_parts").alias("pos", "_part")).join(looks, "_part").select(key, "pos", "symbol", "features")
