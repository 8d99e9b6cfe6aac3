import re

import pytest
from pyspark.sql import functions as F

from framewright.catalog.text import feature_table
from framewright.functions import symbols as Y
from framewright.functions import text as T
from framewright.operators import corpus as C

SAMPLES = ["", "Wait - what?? (yes)", 'A "quoted" text: one, two; three...', "don't re-do it", "a˥˩˥b˩˥˩˥c˧˧d˥˥˩ Nɚ g",
           "ˈaːʰ tʃˈˑãn͡ #", "  x  ~~ y~", "a\u3000\u3000b\u00a0 c\u2003\u2009\u202f\x1c\x85d\u200be。\u3000「f」", "naïve ‥ café，。", "˩˥˩˥˩˥˥˩"]


def values(spark, expr, samples=SAMPLES):
    df = spark.createDataFrame(list(enumerate(samples)), "i int, s string")
    return [r["o"] for r in sorted(df.select("i", expr(F.col("s")).alias("o")).collect())]


def in_order(s, table):
    for old, new in table:
        s = s.replace(old, new)
    return s


@pytest.mark.parametrize("table", [Y.PAUSE_MARKS, Y.PHONE_MARKS, [("a", "b"), ("b", "c"), ("c", ""), ("xy", "a"), ("a", "z")]])
def test_ordered_replacements(spark, table):
    samples = SAMPLES + ["abcxyab", "a-b - c- d"]
    assert values(spark, lambda c: T.replace_in_order(c, table), samples) == [in_order(s, table) for s in samples]


def squeeze(s):
    return re.sub(r"\.+", ".", re.sub(r"\s+", " ", re.sub("~+", "~", s)))


@pytest.mark.parametrize("keep", [True, False])
def test_phone_strings(spark, keep):
    table = Y.PHONE_MARKS + [(c, "") for c in Y.UNSUPPORTED + ("" if keep else Y.MODIFIER_MARKS)]
    want = []
    for s in SAMPLES:
        s = squeeze(in_order(s, table)).strip("~")
        s = in_order(s, Y.tone_contours()) if keep else s
        want.append(re.sub("~+", "~", f"~{s}~#"))
    assert values(spark, lambda c: Y.normalize_phones(c, keep)) == want


def test_wide_blanks_become_one(spark):
    assert values(spark, Y.mark_pauses, ["a\u3000\u3000b", "x\u00a0 \u2028y"]) == ["a b", "x y"]


def test_contour_counts():
    assert len(Y.tone_contours()) == 30 + 30 + 15 + 10
    assert len(Y.FEATURES) == 64 and len(set(Y.SYMBOLS)) == len(Y.SYMBOLS)


def test_ids(spark):
    assert values(spark, Y.symbols_to_ids, ["~a b§~#", "~#"]) == [[0, Y.SYMBOLS.index("a"), 0, Y.SYMBOLS.index("b"), 0], [0, 0]]


def test_features_follow_their_marks(spark):
    table = feature_table(spark)
    base = {r["symbol"]: list(r["features"]) for r in table.collect()}
    texts = ["~aːˈˑtʰ˥ã̰b#", "ˈːa§ʷˈˈe", "o"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {(r["i"], r["pos"]): (r["symbol"], list(r["features"])) for r in Y.symbols_to_features(df, table, "i", "s", Y.SYMBOLS + " ").collect()}
    for i, text in enumerate(texts):
        want, stress = [], False
        for c in text:
            if c == Y.STRESS:
                stress = True
            elif c in Y.SETTING_MARKS and want:
                want[-1][1][Y.FEATURE_INDEX[Y.SETTING_MARKS[c][0]]] = 1
            elif c in Y.TINTING_MARKS and want:
                places = [Y.FEATURE_INDEX[n] for n in Y.TINTING_MARKS[c]]
                if all(want[-1][1][p] != 1 for p in places):
                    for p in places:
                        want[-1][1][p] = 2
            elif c in base:
                want.append((c, list(base[c])))
                if stress:
                    want[-1][1][0] = 1
                stress = False
        assert [got.pop((i, j)) for j in range(len(want))] == want
    assert not got


def test_labels_and_names(spark):
    assert values(spark, T.prepare_label, ["  hello ", "1st", "", "éa"]) == [" Hello", " 1st", " ", " Éa"]
    assert values(spark, T.normalize_words, ["It's a well-known FACT, 42!"]) == [["it's", "a", "well", "known", "fact"]]
    name = values(spark, lambda c: C.result_name(c, F.lit(0.7), F.lit(52), F.lit(None).cast("string")), ["x/my file.a.wav"])
    assert name == ["my_file.a_seed52_rand_adm0p700"]


def test_label_mask(spark):
    df = spark.createDataFrame([(0, [1, 5, 6, 0], 3), (0, [1, 7, 0, 0], 2)], "b int, ids array<int>, length int")
    assert sorted(list(r["ids"]) for r in C.mask_labels(df, 1).collect()) == [[5, 6, -100], [7, -100, -100]]
    other = df.unionByName(spark.createDataFrame([(0, [9, 7, 0, 0], 2)], df.schema))
    assert all(len(r["ids"]) == 4 for r in C.mask_labels(other, 1, batch="b").collect())


def test_phonetic_text_is_not_worked_on_character_by_character(spark):
    """Each of the three took several times as long, in chains of expressions over every character."""
    text = "ðə ˈkæt ʊ˩˥˩n ɚ˥˨, ɫe˧˧˩˥ sæt ã͡n ðə mæt. " * 400
    df = spark.createDataFrame([(i, text) for i in range(64)], "i int, s string").repartition(4).persist()
    df.count()
    phones = df.select("i", Y.normalize_phones(F.col("s")).alias("s"))
    ids = phones.select(F.sum(F.size(Y.symbols_to_ids(F.col("s")))))
    ids.collect()  # starts the workers
    plan = phones.select("i", Y.symbols_to_ids(F.col("s")))._jdf.queryExecution().executedPlan().toString()
    assert "translate" not in plan and "lambda" not in plan
    rows = Y.symbols_to_features(phones, feature_table(spark), "i", "s", Y.SYMBOLS + " ")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "lambda" not in plan and "BroadcastHashJoin" in plan


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(0,), (1,)], "i int").select(F.when(F.col("i") == 1, F.expr("cast(X'61FF62' as string)")).alias("s"))
    got = df.select("s", Y.normalize_phones(F.col("s")).alias("p"), Y.symbols_to_ids(F.col("s")).alias("n")).collect()
    assert [r["p"] for r in got] == [None, "~a�b~#"] and got[0]["n"] is None
