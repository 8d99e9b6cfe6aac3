"""Ranked search, exact copies and whitening against plain loops."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framewright.llm import dual_tree, exact_dedup, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_ranks(docs, items, k=10):
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(words(text))
    out = []
    for item, terms in wanted.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in counted) + 1))) for t in terms}
        scored = []
        for i, c, n in counted:
            m = 10 + (90 * n * n_docs) // length
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, p + 1, i, -s) for p, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def texts(rng, n, vocabulary=400, size=60):
    return [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, size)) % vocabulary) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_dual_tree_search_equals_scoring_all(spark, odd, small, monkeypatch):
    """Ties, repeated rows and ids, nulls; ``small``: many batches, blocks and passes."""
    if small:
        for name, value in {"BATCH_CELLS": 1 << 13, "BLOCK_ITEMS": 6, "PASS_TERMS": 400, "PILOT": 3}.items():
            monkeypatch.setattr(dual_tree, name, value)
    rng = np.random.default_rng(3)
    docs = [(n, t) for n, t in enumerate(texts(rng, 600))]
    docs += [(n % 50, docs[n % 7][1]) for n in range(200)] + [(None, docs[0][1]), (9000, None), (9001, ""), (9002, "...")]
    items = [(n, t) for n, t in enumerate(texts(rng, 30, size=20))] + [(3, "W1 w399"), (None, "w5 w6"), (77, None), (78, "!"), (79, "absent words only"), (80, docs[5][1])]
    got = dual_tree.rank(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "3 as score").repartition(5),
                         spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as number"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranks(docs, items)
    if not small:
        got = dual_tree.rank(odd, odd, item_id="doc_id")
        rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_ranks(rows, rows)
        assert dual_tree.rank(odd, odd.limit(0), item_id="doc_id").count() == 0
        assert dual_tree.rank(odd.limit(0), odd, item_id="doc_id").count() == 0


def test_bounds_cut_off_most_pairs():
    rng = np.random.default_rng(4)
    topics = [rng.choice(2000, 60, replace=False) for _ in range(40)]
    docs = np.zeros((3000, 2000), np.float32)
    for n, row in enumerate(docs):
        row[rng.choice(topics[n % 40], 30, replace=False)] = rng.integers(1, 1000, 30)
    weight = rng.integers(1000, 9000, 2000).astype(float)
    terms = [np.sort(rng.choice(topics[n], 12, replace=False)) for n in range(40)]
    block = dual_tree.Block(list(range(40)), terms, weight)
    searcher = dual_tree.Searcher([block], np.zeros(40, np.int64), 10)
    number, row, score = searcher.search(block, docs[:, block.terms])
    every = np.array([(docs[:, t].astype(float) @ weight[t]) for t in terms]).astype(np.int64)
    for n in range(40):
        assert sorted(score[number == n])[-10:] == sorted(every[n])[-10:]
        assert (every[n][row[number == n]] == score[number == n]).all()
    assert searcher.scored < 0.3 * searcher.pairs


def brute_copies(rows):
    form = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        groups[form(t)].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for key, own in groups.items():
        keep = min(own)
        for _, unnamed, i, n in own:
            out.append((rows[n][0], rows[keep[3]][0], len(own), hashlib.sha256(key.encode()).hexdigest(), (_, unnamed, i) == keep[:3]))
    return out


@pytest.mark.parametrize("heavy", [1024, 1, 3])
def test_exact_dedup(spark, odd, heavy, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    rng = np.random.default_rng(5)
    base = ["copy of many", "two words", "ä ö", "", None, " \t\n", "x" * 20_000]
    rows = [(int(rng.integers(0, 300)) if rng.random() > 0.05 else None, t) for t in rng.choice(np.array(base, object), 400, p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])]
    rows = [(i, t if t is None else t.replace(" ", " " * int(rng.integers(1, 4)))) for i, t in rows] + [(1000 + n, f"alone {n}") for n in range(100)]
    rows += [(r["doc_id"], r["text"]) for r in odd.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'r' as row", "'d' as digest", "'b' as best", "'x' as id").repartition(4)
    got = [(r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"]).hex(), r["kept"]) for r in exact_dedup.mark_copies(docs).collect()]
    want = brute_copies(rows)
    assert sorted((x[:4] for x in got), key=repr) == sorted((x[:4] for x in want), key=repr)
    # Of rows that share id and length, one stays.
    stays = lambda found: sorted(((x[0], x[3]) for x in found if x[4]), key=repr)
    assert stays(got) == sorted(set(stays(want)), key=repr)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    form = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", "", t or "").encode()).hexdigest()
    assert sorted(((r["doc_id"], form(r["text"])) for r in kept.collect()), key=repr) == stays(got)


def test_exact_dedup_runs_no_python_and_takes_empty_tables(odd):
    marked = exact_dedup.mark_copies(odd)
    plan = marked._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert exact_dedup.mark_copies(odd.limit(0)).count() == 0 and exact_dedup.drop_copies(odd.limit(0)).count() == 0


def brute_whitening(rows, k=4):
    used = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in used), default=0)
    used = [(i, x + [0] * (d - len(x))) for i, x in used]
    fit = np.array(sorted({tuple(x) for _, x in used}), float)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in used:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for c in range(k):
            out.setdefault((i, c + 1), []).append((n, deviation, (np.array(x) - fit.mean(axis=0)) @ vectors[:, c] / values[c] ** 0.5, values[c] / (centred**2).sum() * n))
    return out


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(6)
    mixed = rng.standard_normal((300, 24)) @ np.diag(1.3 ** np.arange(24)) / 20 + 3
    rows = [(n, [float(c) for c in v]) for n, v in enumerate(mixed)]
    rows += [(n, rows[7][1]) for n in range(400, 550)] + [(600, None), (601, [float("nan")] * 24), (602, [1.0] * 23 + [None]), (603, [float("-inf")] * 24), (None, rows[3][1]), (5, rows[4][1])]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as x", "3 as id", "4 as component").repartition(3)
    model = whitening.fit_whitening(data)
    got = whitening.whiten(data, model).collect()
    want = brute_whitening(rows)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter({key: len(v) for key, v in want.items()})
    sign = {c: np.sign(next(r["whitened"] for r in got if (r["vec_id"], r["component"]) == (0, c)) * want[0, c][0][2]) for c in range(1, 5)}
    for r in got:
        assert any((r["n"], r["deviation"]) == w[:2] and abs(r["whitened"] * sign[r["component"]] - w[2]) < 1e-9 and abs(r["explained"] / w[3] - 1) < 1e-10
                   for w in want[r["vec_id"], r["component"]])
        assert r["identity_error"] < 1e-9


def test_whitening_finds_equal_eigenvalues_and_edges(spark):
    square = [(n, [float(a), float(b), 0.0]) for n, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]
    data = spark.createDataFrame(square, "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(data)
    assert len(model.values) == 2 and np.allclose(model.values, 256**2 / 2) and model.identity_error < 1e-12
    for rows in ([(1, [1.0, 2.0])], [(1, None)], [(1, [])], [(1, [1.0]), (2, [1.0])]):
        one = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert whitening.whiten(one, whitening.fit_whitening(one)).count() == 0
    assert whitening.whiten(data.limit(0), whitening.fit_whitening(data.limit(0))).count() == 0
    ragged = spark.createDataFrame([(1, [1.0]), (2, [2.0, 1e9]), (3, [])], "vec_id long, embedding array<double>")
    got = whitening.whiten(ragged, whitening.fit_whitening(ragged)).collect()
    assert len(got) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in got)
