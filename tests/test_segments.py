import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import segments as G

SCHEMA = "utt_id bigint, seg bigint, start double, end double, text string, words array<string>"


def corpus(seed):
    rnd = random.Random(seed)
    out = []
    for utt in range(6):
        at = 0.0
        for seg in range(rnd.choice([1, 2, 9, 60])):
            words = ["w" * rnd.randint(1, 6) for _ in range(rnd.choice([0, 1, 2, 5, 9]))]
            out.append((utt, seg, at, at + len(words), " " + " ".join(words) + rnd.choice(["", " "]), words))
            at += len(words)
    return out


def merged(rows, min_words, min_chars):
    groups = []
    for _, seg, start, end, text, words in rows:
        if groups and (len(groups[-1]["words"]) < min_words or len(groups[-1]["text"]) < min_chars):
            g = groups[-1]
            g.update(text=g["text"].strip() + " " + text.strip(), words=g["words"] + words, end=end, last=seg)
        else:
            groups.append(dict(first=seg, last=seg, start=start, end=end, text=text, words=list(words)))
    return [(g["first"], g["last"], g["start"], g["end"], g["text"], g["words"]) for g in groups]


@pytest.mark.parametrize("block,halo", [(8192, 256), (7, 2), (4, 1)])
def test_merge_matches_the_plain_loop(spark, block, halo):
    rows = corpus(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got: dict = {}
    for r in G.merge_segments(df, 12, 40, block, halo).collect():
        got.setdefault(r["utt_id"], []).append(tuple(r[1:]))
    for utt in {r[0] for r in rows}:
        assert sorted(got[utt]) == merged([r for r in rows if r[0] == utt], 12, 40)


def test_a_way_over_many_blocks_is_found_by_doubling(spark, monkeypatch):
    """5,000 segments in blocks of 4 with one group of 1,000: about log2 rounds, each doubles the marked doors."""
    rounds, inner = [], G.materialize

    def counting(df, label):
        made = inner(df, label)
        rounds.append(label)
        return made

    monkeypatch.setattr(G, "materialize", counting)
    words = lambda seg: [] if 2000 <= seg < 3000 else ["word"] * (1 + seg % 3)
    rows = [(7, seg, float(seg), seg + 1.0, " ".join(words(seg)), words(seg)) for seg in range(5000)]
    got = G.merge_segments(spark.createDataFrame(rows, SCHEMA), 6, 5, 64, 16)
    assert sorted(tuple(r[1:]) for r in got.collect()) == merged(rows, 6, 5)
    assert 3 <= rounds.count("reached") <= 8


def sequence(spark, values, name="code"):
    return spark.createDataFrame([(u, i, v) for u, vs in values.items() for i, v in enumerate(vs)],
                                 f"utt_id bigint, frame bigint, {name} bigint")


def read(df, name="code"):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["utt_id"], r["frame"])):
        out.setdefault(r["utt_id"], []).append(r[name])
    return out


def test_alignment_and_hold_across_blocks(spark):
    frames = sequence(spark, {0: [9, 9, 1, 9, 1, 2, 2, 9, 1, 9], 1: [9, 9], 2: [3]}, "phone")
    runs = sorted(tuple(r) for r in G.alignment_runs(frames, 9, block=2).collect())
    assert runs == [(0, 0, 1, 0, 5), (0, 1, 2, 5, 8), (0, 2, 1, 8, 10), (2, 0, 3, 0, 1)]
    assert read(G.ctc_hold(frames, 9, block=2), "held") == {0: [0, 0, 1, 1, 1, 2, 2, 2, 1, 1], 1: [0, 0], 2: [3]}
    unique = G.unique_consecutive(frames, "phone", block=3)
    assert read(unique, "phone") == {0: [9, 1, 9, 1, 2, 9, 1, 9], 1: [9], 2: [3]}


def test_ends(spark):
    codes = sequence(spark, {0: [4, 0, 5, 0, 0], 1: [0, 0], 2: [7, 8]})
    assert read(G.trim_tail(codes, F.col("code") != 0)) == {0: [4, 0, 5], 1: [0, 0], 2: [7, 8]}
    assert read(G.append_eos(codes, 99)) == {0: [4, 0, 5, 99, 0, 0], 1: [99, 0, 0], 2: [7, 8, 99]}
    marked = sequence(spark, {0: [1, 99, 2, 99], 1: [3, 4]})
    assert read(G.mask_after_eos(marked, 99)) == {0: [1, 99, -1, -1], 1: [3, 4]}
    assert read(G.mask_after_eos(marked, 99, keep_eos=False)) == {0: [1, -1, -1, -1], 1: [3, 4]}
    assert read(G.cut_at_eos(marked, F.col("code") == 99)) == {0: [1], 1: [3, 4]}


def test_word_bounds_across_blocks(spark):
    rows = [(0, i, s, d) for i, (s, d) in enumerate([(0, 2), (1, 3), (1, 4), (0, 1), (2, 5), (0, 2), (0, 1)])]
    durs = spark.createDataFrame(rows, "utt_id bigint, pos bigint, symbol_id bigint, dur bigint")
    got = sorted(tuple(r) for r in G.word_bounds(durs, block=2).collect())
    assert got == [(0, 0, 2, 9), (0, 1, 10, 15), (0, 2, 17, 17)]


def test_ranges_join_once_per_frame(spark):
    frames = sequence(spark, {0: list(range(50))})
    ranges = spark.createDataFrame([(0, 0, 3, 20), (0, 1, 18, 19), (0, 2, 9, 9)], "utt_id bigint, seg bigint, f0 bigint, f1 bigint")
    got = G.frames_in_ranges(frames, ranges, width=4)
    assert got.count() == 18
    assert G.frames_in_ranges(frames, ranges.filter("seg = 0"), how="left", width=4).count() == 50


def test_crops_have_the_asked_size(spark):
    codes = sequence(spark, {0: list(range(1, 41)), 1: [1, 2, 3]})
    out = read(G.random_crop(codes, 10, 4, "code", block=8))
    assert out[1] == [1, 2, 3] + [0] * 7
    assert len(out[0]) == 10 and out[0] == list(range(out[0][0], out[0][0] + 10))
