import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import editing as E


def spliced(base, ops, k):
    """The plain loop: spans from the last to the first on whole arrays."""

    def join(a, b):
        w = min(k, len(a), len(b))
        if w == 0:
            return np.vstack([a, b])
        r = np.linspace(0, 1, w + 2)[1:-1][:, None]
        mix = a[len(a) - w:] * (1 - r) + b[:w] * r
        mix[:, 0] = (a[len(a) - w:, 0] + b[:w, 0]) / 2
        return np.vstack([a[:len(a) - w], mix, b[w:]])

    for start, end, piece in sorted(ops, key=lambda o: o[0], reverse=True):
        base = join(join(base[:start], piece), base[end:])
    return base


def scenario(seed):
    """Random recordings and spans: far, close, touching, overlapping, empty pieces, at both ends."""
    rng = np.random.default_rng(seed)
    bases, ops = {}, {}
    for utt in range(8):
        n = int(rng.choice([5, 30, 120]))
        bases[utt] = rng.normal(size=(n, 3))
        starts = np.sort(rng.integers(0, n + 1, int(rng.integers(0, 7))))
        ops[utt] = [(int(s), int(s + rng.integers(0, 12)), rng.normal(size=(int(rng.choice([0, 1, 3, 9, 25])), 3)))
                    for s in starts]
    return bases, ops


@pytest.mark.parametrize("seed,k", [(1, 8), (2, 3), (3, 0), (4, 5)])
def test_splices_match_the_plain_loop(spark, seed, k):
    bases, ops = scenario(seed)

    def rows(a):
        return [(i, float(r[0]), [float(x) for x in r[1:]]) for i, r in enumerate(a)]

    base = spark.createDataFrame([(u, *r) for u, a in bases.items() for r in rows(a)],
                                 "utt_id bigint, frame bigint, f0 double, vec array<double>").repartition(3)
    spans = spark.createDataFrame([(u, i, s, e) for u, o in ops.items() for i, (s, e, _) in enumerate(o)],
                                  "utt_id bigint, op bigint, start_frame bigint, end_frame bigint")
    pieces = spark.createDataFrame(
        [(u, i, *r) for u, o in ops.items() for i, (_, _, p) in enumerate(o) for r in rows(p)],
        "utt_id bigint, op bigint, frame bigint, f0 double, vec array<double>")
    got: dict = {}
    for r in E.apply_splices(base, spans, pieces, k).collect():
        got.setdefault(r["utt_id"], {})[r["frame"]] = [r["f0"], *r["vec"]]
    for utt in bases:
        want = spliced(bases[utt], ops[utt], k)
        have = got.get(utt, {})
        assert sorted(have) == list(range(len(want))), utt
        if len(want):
            np.testing.assert_allclose(np.array([have[i] for i in sorted(have)]), want, atol=1e-9)


def test_group_and_pair(spark):
    picked = spark.createDataFrame([(0, i) for i in (5, 3, 4, 9, 3)] + [(1, 2)], "utt_id bigint, word_idx bigint")
    groups = E.group_consecutive(picked, block=2)
    assert sorted(tuple(r) for r in groups.collect()) == [(0, 0, 3, 5, 3), (0, 1, 9, 9, 1), (1, 0, 2, 2, 1)]
    texts = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d")], "utt_id bigint, k bigint, text string")
    paired = E.pair_replacements(groups, texts)
    assert {r["error"] for r in paired.filter("utt_id = 1").collect()} == {"2 texts for 1 groups"}
    assert sorted(r["text"] for r in paired.filter("utt_id = 0").collect()) == ["a", "b"]


def test_splice_length(spark):
    base = spark.range(60).select(F.lit(0).cast("bigint").alias("utt_id"), F.col("id").alias("frame"),
                                  F.lit(100.0).alias("f0"), F.array(F.col("id").cast("double")).alias("vec"))
    span = spark.createDataFrame([(0, 20, 30)], "utt_id bigint, start_frame bigint, end_frame bigint")
    piece = base.filter("frame < 25")
    assert E.graft_splice(base, piece, span, 8, block=16).count() == 60 - 10 + 25 - 16
    assert E.hard_splice(base, piece, span).count() == 60 - 10 + 25


def test_dictionary_above_the_limit(spark):
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate("Ada, met (Grace) and ada".split())], "utt_id bigint, word_idx bigint, word string")
    terms = spark.createDataFrame([("ada", "NAME"), ("grace", "NAME"), ("unused", "X")], "term string, label string")
    for limit in (1 << 20, 1):
        got = sorted(r["word_idx"] for r in E.tag_entities(words, dictionary=terms, limit_bytes=limit).collect())
        assert got == [0, 2, 4]


def brute_tags(words, terms):
    clean = lambda w: re.sub(r"^\W+|\W+$", "", w.lower())
    known, out = {}, set()
    for term, label in terms:
        known.setdefault(tuple(term.split()), set()).add(label)
    for utt in {u for u, *_ in words}:
        own = [w for u, _, w in sorted(words) if u == utt]
        at = 0
        while at < len(own):
            k = next((k for k in range(5, 0, -1) if tuple(map(clean, own[at : at + k])) in known and at + k <= len(own)), 0)
            out |= {(utt, at + d, own[at + d], label) for d in range(k) for label in known[tuple(map(clean, own[at : at + k]))]}
            at += k or 1
    return out


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_terms_of_several_words(spark, limit):
    """Leftmost and longest, chains of overlaps, several labels, block edges, and a dictionary beyond the broadcast limit."""
    rng = np.random.default_rng(2)
    words = [(u, i, ["new", "York", "(city)", "of", "the", "Old,", "town."][rng.integers(0, 7)]) for u in range(4) for i in range(200)]
    terms = [("new york", "PLACE"), ("new york city", "PLACE"), ("new york city", "TOWN"), ("york city of", "X"), ("city of the old town", "LONG"), ("of the", "Y"),
             ("the old", "Z"), ("town", "ONE"), ("old", "ONE"), ("town new", "V"), ("  the   new ", "BLANKS"), ("never there", "N")]
    df = spark.createDataFrame(words, "utt_id bigint, word_idx bigint, word string").repartition(3)
    got = E.tag_entities(df, dictionary=spark.createDataFrame(terms, "term string, label string"), limit_bytes=limit)
    assert {tuple(r) for r in got.collect()} == brute_tags(words, [(" ".join(t.split()), x) for t, x in terms])


def test_contexts_are_cut_from_one_text(spark):
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate(["a", "bc", "", None, "déf", "g"])] + [(1, 0, "x")], "utt_id bigint, word_idx bigint, word string")
    groups = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 1, 2), (0, 2, 3, 3), (0, 3, 4, 5), (0, 4, 0, 5), (0, 5, 9, 9), (1, 0, 0, 0)], "utt_id bigint, group_no bigint, first bigint, last bigint")
    got = {(r["utt_id"], r["group_no"]): (r["prefix"], r["suffix"]) for r in E.context_strings(words, groups).collect()}
    assert got == {(0, 0): ("", " bc  déf g"), (0, 1): ("a ", " déf g"), (0, 2): ("a bc  ", " déf g"), (0, 3): ("a bc  ", ""), (0, 4): ("", ""),
                   (0, 5): ("a bc  déf g ", ""), (1, 0): ("", "")}
