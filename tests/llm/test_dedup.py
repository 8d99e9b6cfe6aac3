"""Repeated byte strings, near-duplicate classes, packing and the pipeline against plain loops."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import groups, near_dedup, packing, suffix_dedup
from framewright.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


def brute_repeats(rows):
    out, seen = [], set()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        body = (text or "").encode()
        away = np.zeros(len(body), bool)
        for p in range(len(body) - 99):
            if body[p : p + 100] in seen:
                away[p : p + 100] = True
            seen.add(body[p : p + 100])
        kept = np.frombuffer(body, np.uint8)[~away].tobytes()
        runs = int((np.diff(np.concatenate([[0], away.astype(int)])) == 1).sum())
        out.append((i, len(body), int(away.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 400])
def test_suffix_dedup(spark, odd, block, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", block)
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    base = word(900)
    rows = [(100, base), (101, word(80) + base[100:350] + word(50)), (102, base[200:420] + base[200:420]), (103, "ab" * 300), (104, "xab" * 200), (105, "ab" * 49 + "a"),
            (106, base[:99]), (107, base[:99] + "é"), (108, base)] + [(110 + i, word(60) + base[300:410] + word(60)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats(rows)
    if block > 400:
        short = odd.filter("doc_id is null or doc_id not in (4, 5)")
        got = suffix_dedup.remove_repeats(short)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_repeats([(r["doc_id"], r["text"]) for r in short.collect()])
        assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_interval_expansion_equals_sorting():
    rng = np.random.default_rng(6)
    for _ in range(20):
        text = rng.integers(97, 100, rng.integers(2, 400)).astype(np.uint8)
        text[-1] = 255
        order, bwt = suffix_dedup.transform(text)
        raw = text.tobytes()
        parted = suffix_dedup.separated(order, bwt, text, 6)
        want = [True] + [raw[a : a + 6] != raw[b : b + 6] for a, b in zip(order[:-1], order[1:], strict=True)]
        inside = order + 6 <= len(raw) - 1
        assert all(p == w for p, w, ok, before in zip(parted, want, inside, [True, *inside[:-1]], strict=True) if ok and before)


def brute_classes(rows, least=0.8):
    grams = {}
    for n, (_, text) in enumerate(rows):
        w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
        if w:
            grams[n] = Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4)))
    label = list(range(len(rows)))
    for a in grams:
        for b in grams:
            if a < b:
                shared = sum((grams[a] & grams[b]).values())
                if shared >= least * (sum(grams[a].values()) + sum(grams[b].values()) - shared):
                    old, new = label[b], label[a]
                    label = [new if x == old else x for x in label]
    least_id = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least_id[label[n]].append(i)
    return sorted(((i, min(least_id[label[n]], default=None)) for n, (i, _) in enumerate(rows)), key=repr)


def near_rows():
    rng, rows = np.random.default_rng(8), []
    for g in range(25):
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(3, 120))]
        for _ in range(rng.integers(1, 6)):
            own = list(words)
            for p in rng.integers(0, len(own), rng.integers(0, 3)):
                own[p] = f"v{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own)))
    # a star: edits of one text that resemble it, but hardly each other
    words = [f"s{x}" for x in rng.integers(0, 400, 200)]
    rows.append((len(rows), " ".join(words)))
    for _ in range(40):
        own = list(words)
        for p in rng.choice(200, 4, replace=False):
            own[p] = f"t{rng.integers(0, 10_000)}"
        rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("chunk", [1500, 8])
def test_near_duplicate_classes(spark, odd, chunk, monkeypatch):
    monkeypatch.setattr(groups, "CHUNK_ROWS", chunk)
    rows = near_rows() + [(1000 + (r["doc_id"] or 0) if r["doc_id"] else None, r["text"]) for r in odd.collect() if len(r["text"] or "") < 5000]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_classes(rows)


@pytest.mark.parametrize("bridge", [True, False])
def test_one_bridge_joins_families_over_chunks(spark, bridge, monkeypatch):
    """Two families of each group, joined by the link of one member near either: chunks start from different families."""
    monkeypatch.setattr(groups, "CHUNK_ROWS", 6)

    def compare(payloads):
        at = np.array([int(p) for p in payloads])
        value, many = np.unique(at, return_counts=True)
        return int(np.flatnonzero(at == value[np.argmax(many)])[0]), lambda p: abs(at - at[p]) <= 2

    rows = [(g, f"{g}/{k}".encode(), str(x).encode(), 1) for g in range(60) for k, x in enumerate([0] * 10 + [5] * 10 + ([2, 3] if bridge else []))]
    members = spark.createDataFrame(rows, "group long, node binary, payload binary, weight long")
    sizes = members.groupBy("group").agg(F.count("node").alias("n"), F.sum("weight").alias("total"))
    got = groups.components(groups.linked_members(members, sizes, compare)).collect()
    roots = defaultdict(set)
    for r in got:
        roots[bytes(r["node"]).split(b"/")[0]].add(bytes(r["root"]))
    assert len(got) == len(rows) and Counter(map(len, roots.values())) == {1 if bridge else 2: 60}


def test_dart_collisions_estimate_similarity():
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 2**63, 600, dtype=np.uint64)
    a, b = np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)]), np.concatenate([shared, rng.integers(0, 2**63, 300, dtype=np.uint64)])
    doc = np.concatenate([np.zeros(700, np.int64), np.ones(900, np.int64)])
    s = near_dedup.throw_darts(doc, np.concatenate([a, b]), 2, 4000)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.03
    assert (near_dedup.throw_darts(np.zeros(1, np.int64), shared[:1], 1, 80) > 0).any()


def test_keep_first_of_class(odd, empty):
    got = near_dedup.keep_first_of_class(odd)
    assert got.columns == odd.columns
    ids = sorted((r["doc_id"] for r in got.collect()), key=repr)
    assert ids.count(7) == 0 or ids.count(7) == 1
    assert {2, 3, 12} <= set(ids)
    assert 4 in ids and 5 not in ids
    assert near_dedup.keep_first_of_class(empty).count() == 0


def test_keep_decides_by_row_where_ids_are_shared_or_missing(spark):
    rng = np.random.default_rng(13)
    a, b = (" ".join(f"{k}{x}" for x in rng.integers(0, 500, 80)) for k in "ab")
    cases = [
        ([(5, a), (5, b)], [(5, a), (5, b)]),
        ([(3, b), (5, a), (5, b + " x")], [(3, b), (5, a)]),
        ([(None, a), (None, b + " x"), (3, b), (None, "")], [(None, a), (3, b), (None, "")]),
        ([(None, a), (None, a), (7, b), (7, b), (8, None), (8, None)], [(None, a), (7, b), (8, None)]),
    ]
    for rows, want in cases:
        got = near_dedup.keep_first_of_class(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_documents_heavier_than_a_chunk_meet_at_once(spark, monkeypatch):
    """Near copies of ten times the bound each: linked without one level of recursion per chunk."""
    monkeypatch.setattr(groups, "CHUNK_WEIGHT", 60)
    levels, inner = [], groups.linked_members

    def counting(rows, sizes, compare, level=0):
        levels.append(level)
        return inner(rows, sizes, compare, level)

    monkeypatch.setattr(groups, "linked_members", counting)
    rng, rows = np.random.default_rng(14), []
    for g in range(3):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 600)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:-2], "other", "end"]))]
    got = near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == brute_classes(rows)
    assert max(levels) <= 2


def test_components(spark):
    pairs = [(b"a", b"b"), (b"c", b"b"), (b"x", b"y"), (b"d", b"c"), (b"e", b"d"), (b"q", b"q")] + [(b"hub", str(i).encode()) for i in range(30)]
    got = {bytes(r["node"]): bytes(r["root"]) for r in groups.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert {got[k] for k in (b"a", b"b", b"c", b"d", b"e")} == {b"a"} and got[b"y"] == got[b"x"] == b"x" and b"q" not in got
    assert {got[str(i).encode()] for i in range(30)} == {got[b"hub"]}


def check_pieces(pieces, texts, window=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in texts]
    want = Counter((i, len(x)) for (i, _), x in zip(texts, ids, strict=True))
    assert Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0) == want
    known = defaultdict(list)
    for (i, _), x in zip(texts, ids, strict=True):
        known[i].append(x)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids))
    for p in pieces:
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in known[p["doc_id"]])
    rows = defaultdict(list)
    for p in pieces:
        rows[p["sequence_id"]].append((p["offset"], p["length"]))
    short = 0
    for own in rows.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= window
        short += end < window
    return short


@pytest.mark.parametrize("shard_bytes", [6 << 20, 2000])
def test_packing(spark, odd, shard_bytes):
    odd = odd.union(odd.limit(1).withColumn("doc_id", F.lit(20).cast("long")).withColumn("text", F.lit("a <|endoftext|> b<|endoftext|><|endoftext x")))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = packing.pack(odd, tokenizer_path(), shard_bytes=shard_bytes, with_ids=True).collect()
    short = check_pieces(got, rows)
    assert short == 1 if shard_bytes > 2000 else short >= 1
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in got)
    assert packing.pack(odd.limit(0), tokenizer_path()).count() == 0


def test_bm25_scores_and_greedy_choice_equal_plain_loops():
    """Common and rare terms, ties and empty documents; neighbours come in the order of all scores."""
    rng = np.random.default_rng(10)
    ids = [np.append(rng.zipf(1.2, rng.integers(0, 120)) % 800, 1).astype("<u2") for _ in range(150)]
    ids += [ids[3], ids[3], np.array([1], "<u2")]
    counts = [Counter(x[:-1].tolist()) for x in ids]
    df = Counter(t for c in counts for t in c)
    mean = np.mean([len(x) for x in ids])
    idf = {t: np.log(1 + (len(ids) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    index = packing.Index(ids)
    for seed in (0, 3, 77, len(ids) - 1):
        want = [sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in counts[seed] if t in c) for c, x in zip(counts, ids, strict=True)]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
    used = set(rng.integers(0, len(ids), 40).tolist()) | {3}
    index.used[list(used)] = True
    want = sorted((d for d in range(len(ids)) if d not in used and index.scores(3)[d] > 0), key=lambda d: (-index.scores(3)[d], d))
    assert [d for d, _ in zip(index.neighbours(3), want, strict=False)] == want
    # Every window follows its seed: the next document laid is the seed's best that is left.
    order = list(dict.fromkeys(d for d, *_ in packing.fill(ids, 64)))
    assert sorted(order) == list(range(len(ids)))
    index, left = packing.Index(ids), set(range(len(ids)))
    left.remove(order[0])
    best = max(left, key=lambda d: (index.scores(order[0])[d], -d))
    assert order[1] == best


def test_packing_puts_neighbours_together():
    rng = np.random.default_rng(11)
    topics = [rng.integers(1000 * t, 1000 * t + 50, 300).astype("<u4") for t in range(8)]
    ids = [rng.permutation(topics[n % 8])[:200] for n in range(64)]
    index = packing.Index(ids)
    index.used[3] = True
    first = [d for d, _ in zip(index.neighbours(3), range(7), strict=False)]
    assert all(d % 8 == 3 for d in first)


def test_packing_deals_by_content_and_weighs_by_all_documents(spark):
    """Near copies scattered over the ids meet in a shard; document frequencies are those of the whole table."""
    rng = np.random.default_rng(12)
    bases = [[f"{chr(97 + b)}{x}" for x in rng.integers(0, 500, 100)] for b in range(8)]
    rows = [(n, " ".join([*bases[n % 8], f"own {n}"])) for n in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, tokenizer_path(), shard_bytes=10_000).collect()
    check_pieces(got, rows)
    # A window of four documents holds copies of one text, or of two at a seam.
    held = defaultdict(set)
    for p in got:
        held[p["sequence_id"]].add(p["doc_id"] % 8)
    assert len(held) > 8 and np.mean([len(x) for x in held.values()]) < 2.5
    ids = [np.array([5, 6, 1], "<u4"), np.array([5, 1], "<u4"), np.array([6, 1], "<u4")]
    index = packing.Index(ids, packing.Corpus(np.array([0, 0, 0, 0, 0, 9000, 3]), 10_000, 3.0))
    index.used[0] = True
    assert next(index.neighbours(0)) == 2


def test_pipeline_stages(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) as n_chars", "1 as n_words", "true as contaminated")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "contaminated"]
        docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_pipeline_result(spark):
    """The stages' decisions, redone by hand on the smallest tables."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    from test_text_rules import ascii_lower, brute_hits, STRIP

    good = {r["doc_id"] for r in QUERIES["op10_quality_classifier"](spark, SF).collect() if r["predicted"]}
    rows = {i: t for i, t in docs.items() if i in good}
    holders = defaultdict(set)
    for i, t in rows.items():
        for line in t.split("\n"):
            key = ascii_lower(line.strip(STRIP))
            if len(key) >= 40:
                holders[key].add(i)
    gone = lambda i, x: len(h := holders[ascii_lower(x.strip(STRIP))]) >= 5 and i != max(h)
    rows = {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in rows.items()}
    keep = {i for i, c in brute_classes(sorted(rows.items())) if i == c}
    rows = {i: rows[i] for i in keep}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r[0]: rows[r[0]] for r in brute_hits(sorted(rows.items()), items) if not r[5]}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), sorted(rows.items()))
