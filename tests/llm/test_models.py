"""Trained operators: the quality classifier, language codes and the hidden Markov model."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import hidden_markov, language, quality
from framewright.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.01"


def test_folds(spark):
    ids = spark.createDataFrame([(0,), (17,), (None,)], "doc_id long")
    got = [r[0] for r in ids.select(held_out("doc_id", 4, 2)).collect()]
    assert got == [zlib.crc32(b"0") % 4 == 2, zlib.crc32(b"17") % 4 == 2, False]


def test_quality_separates_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op10_quality_classifier"](spark, SF).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_score_is_a_sparse_product(spark, odd):
    weights = np.random.default_rng(3).normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    grams = quality.Features()
    for r in quality.score(odd, weights, keep=["doc_id", "text"]).collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        at = grams.grams(data, np.array([0, len(data)]))[1]
        margin = weights[at].astype(float).sum() * quality.SCALE / max(1, len(at)) + weights[-1]
        assert math.isclose(r["score"], 1 / (1 + math.exp(-min(35, max(-35, margin)))), rel_tol=1e-5)


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 1), (7, 0), (None, 1), (10, None)], "doc_id long, quality int")
    weights = quality.train(odd, labels, F.lit(True))
    assert np.isfinite(weights).all() and quality.score(odd, weights).count() == odd.count()
    none = quality.train(odd, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(empty, none).count() == 0 and not quality.train(empty, labels, F.lit(True)).any()


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 20])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert code.shape[0] == n and (np.abs(code.sum(axis=0)) < n).all()
    least = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
    assert least >= (1 if n == 2 else 2 if n == 3 else 4)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    got = QUERIES["op4_language_codes"](spark, SF).join(docs, "doc_id").filter("held_out and n_chars > 60").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97


def test_language_edges(spark, odd, empty):
    model = language.train(odd, F.lit(True))
    assert model["languages"] == ["de", "en", "es", "fr"]
    got = language.predict(odd, model, keep=["doc_id", "text"]).collect()
    assert len(got) == odd.count()
    for r in got:
        spoken = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not spoken) and (r["score"] > 0) == spoken and r["score"] <= 1
    nothing = language.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    one = language.train(odd.filter("lang = 'fr'"), F.lit(True))
    assert {r["lang_pred"] for r in language.predict(odd, one).collect()} == {"fr", "und"}
    assert language.predict(empty, model).count() == 0


def brute_log10(model, classes):
    """All state sequences by the plain recursion in log space."""
    with np.errstate(divide="ignore"):
        v = np.log(model.start)
        for c in classes:
            v = np.array([np.logaddexp.reduce(v + np.log(model.move[:, s])) + np.log(model.emit[c, s]) for s in range(len(v))])
    return np.logaddexp.reduce(v) / math.log(10)


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    k = hidden_markov.STATES
    return hidden_markov.Model.from_counts(rng.gamma(0.3, 50, (1 + k + hidden_markov.PAD + 1, k)))


def test_forward_is_exact():
    model, rng = random_model(), np.random.default_rng(1)
    texts = [rng.integers(0, 50, n) for n in (1, 2, 63, 64, 65, 300)]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    grid, start = hidden_markov.runs(np.concatenate(texts), first)
    got = model.log10(grid, start)
    assert np.allclose(got, [brute_log10(model, t) for t in texts], rtol=1e-10)


def test_baum_welch_counts_and_likelihood():
    rng = np.random.default_rng(2)
    classes, first = rng.integers(0, 9, 1000), np.array([0, 10, 400, 1000])
    classes[400:] += 9
    grid, start = hidden_markov.runs(classes, first)
    model, before = hidden_markov.Model.uneven(np.bincount(classes, minlength=hidden_markov.PAD + 1)), -math.inf
    for _ in range(5):
        counts = model.expected(grid)
        k = hidden_markov.STATES
        assert math.isclose(counts[0].sum(), len(grid), rel_tol=1e-4)
        assert math.isclose(counts[1 : 1 + k].sum(), 1000, rel_tol=1e-4) and math.isclose(counts[1 + k :].sum(), 1000, rel_tol=1e-4)
        now = model.log10(grid, np.arange(len(grid) + 1)).sum()
        assert now > before - 1.0  # smoothing may cost a little
        model, before = hidden_markov.Model.from_counts(counts), now


def brute_counts(model, run, begin):
    """Forward-backward over all paths of states, one by one."""
    k, out = len(model.start), np.zeros((1 + len(model.start) + hidden_markov.PAD + 1, len(model.start)))
    weights = {}
    for path in itertools.product(range(k), repeat=len(run) + 1):
        w = begin[path[0]]
        for a, b, c in zip(path[:-1], path[1:], run, strict=True):
            w *= model.move[a, b] * model.emit[c, b]
        weights[path] = w
    total = sum(weights.values())
    for path, w in weights.items():
        out[0, path[0]] += w / total
        for a, b, c in zip(path[:-1], path[1:], run, strict=True):
            out[1 + a, b] += w / total
            out[1 + k + c, b] += w / total
    return out


def test_expected_counts_equal_plain_forward_backward(monkeypatch):
    monkeypatch.setattr(hidden_markov, "STATES", 3)
    model, rng = random_model(3), np.random.default_rng(4)
    texts = [rng.integers(0, 7, n) for n in (2, 4, 6)]
    grid, begin = hidden_markov.runs(np.concatenate(texts), np.array([0, 2, 6, 12]), 4)
    opens = np.zeros(len(grid), bool)
    opens[begin[:-1]] = True
    assert opens.tolist() == [True, True, True, False]
    want = np.zeros((1 + 3 + hidden_markov.PAD + 1, 3))
    for run, first in zip(grid, opens, strict=True):
        counts = brute_counts(model, [c for c in run if c != hidden_markov.PAD], model.start if first else model.stationary())
        if not first:
            counts[0] = 0
        want += counts
    assert np.allclose(model.expected(grid, opens), want, rtol=1e-3, atol=1e-4)


def test_decoding_equals_a_plain_loop(spark):
    rows = [(n, f"{'the cat and dog' if n % 3 else 'el gato y perro'} {n} {'x' * (n % 4)}", "en" if n % 3 else "es") for n in range(120)] + [(500, "123", "fr"), (501, "ciao bella", "it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True))
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    grams = language.Grams()
    for n, text, _ in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        _, at = grams.of(raw, np.array([0, len(raw)]))
        losses = []
        for word in model["code"]:
            loss = 0.0
            for b, sign in enumerate(word):
                margin = sum(float(model["weights"][a, b]) for a in at) * language.SCALE / max(1, len(at)) + float(model["weights"][-1, b])
                loss += math.log1p(math.exp(-margin * sign)) * model["bit_weight"][b]
            losses.append(loss)
        chance = [math.exp(-x) for x in losses]
        if any(c.isalpha() for c in text):
            assert got[n]["lang_pred"] == model["languages"][int(np.argmin(losses))] and math.isclose(got[n]["score"], max(chance) / sum(chance), rel_tol=1e-4)
        else:
            assert (got[n]["lang_pred"], got[n]["score"]) == ("und", 0.0)


def test_samples_hold_where_many_rows_share_an_id(spark):
    """Equal rows count once; different rows of one id are drawn each for itself, in or out of the sample."""
    for hot in (1, 7, 12345):
        equal = [(hot, "the same text in english again", "en")] * 3000
        other = [(hot, f"text {n} in english", "en") for n in range(500)] + [(n, f"texto {n} en español", "es") for n in range(2000, 2100)]
        docs = spark.createDataFrame(equal + other, "doc_id long, text string, lang string")
        model = language.train(docs, F.lit(True), max_train=100)
        assert model["languages"] == ["en", "es"]
        assert [r["lang_pred"] for r in language.predict(docs.limit(1), model).collect()] == ["en"]
        labels = spark.createDataFrame([(hot, 1), (hot, 1)] + [(n, 0) for n in range(2000, 2100)], "doc_id long, quality int")
        weights = quality.train(docs, labels, F.lit(True), max_train=150)
        assert np.isfinite(weights).all() and np.abs(weights).sum() > 0


def test_hidden_markov_edges(spark, odd, empty):
    got = hidden_markov.score_texts(odd, F.col("id") % 3 != 0).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(got) == odd.count()
    tokens = lambda t: [w.encode().lower() for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w] + [b"\n"]
    c = Counter(w for r in odd.collect() if r["doc_id"] is not None and r["doc_id"] % 3 for w in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isfinite(r["score"]) and r["score"] <= 0
    assert hidden_markov.score_texts(empty, F.lit(True)).count() == 0
    unknown = hidden_markov.score_texts(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in unknown)


def test_token_probabilities_sum_to_one(spark):
    """Over all known tokens and one unknown, the shares of a class sum to one."""
    c = np.array([5, 3, 1])
    assert math.isclose(sum((c + 1) / (c.sum() + len(c) + 1)) + 1 / (c.sum() + len(c) + 1), 1)
    model = random_model()
    assert np.allclose(model.emit[: hidden_markov.PAD].sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
