"""The registered edit against plain loops over the same tables."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.catalog import load
from framewright.catalog.editing import base_frames
from framewright.operators.editing import GRAFT
from framewright.plans import bindings as B
from test_editing import spliced

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not found")


def stats(f0):
    logs = np.log(f0[f0 != 0])
    return logs.mean(), logs.std()


def test_edit_query(spark):
    rows = {}
    for r in base_frames(spark, SF).collect():
        rows.setdefault(r["utt_id"], {})[r["frame"]] = [r["f0"], *r["vec"]]
    base = {u: np.array([x[i] for i in range(len(x))]) for u, x in rows.items()}
    words = {}
    for r in B.words(spark, SF).filter(F.col("utt_id").isin(list(base))).collect():
        words.setdefault(r["utt_id"], {})[r["word_idx"]] = (r["start"], r["end"])
    want = {}
    for utt, frames in base.items():
        own = words.get(utt, {})
        picked = sorted(i for i in own if i % 7 in (0, 1))
        groups = []
        for i in picked:
            if groups and groups[-1][-1] == i - 1:
                groups[-1].append(i)
            else:
                groups.append([i])
        want[utt] = frames
        if not groups or len(groups) != len(picked) // 2 + len(picked) % 2:
            continue  # the counts of texts and groups differ
        share = len(frames) / max(e for _, e in own.values()) / 50
        piece = frames[::5].copy()
        (m, s), (rm, rs) = stats(piece[:, 0]), stats(frames[:, 0])
        voiced = piece[:, 0] != 0
        piece[voiced, 0] = np.exp((np.log(piece[voiced, 0]) - m) / max(s, 1e-8) * rs + rm)
        spans = [(max(round(own[g[0]][0] * share * 50), 0), round(own[g[-1]][1] * share * 50)) for g in groups]
        order = sorted(range(len(spans)), key=lambda op: (spans[op][0], -op))
        edited = frames
        for op in reversed(order):
            edited = spliced(edited, [(*spans[op], piece)], GRAFT)
        want[utt] = edited
    got = {}
    for r in load()[0]["P4_edit"](spark, SF).collect():
        got.setdefault(r["utt_id"], {})[r["frame"]] = (r["f0"], r["first"], r["last"], r["weighted"])
    assert got.keys() == want.keys() and any(len(want[u]) != len(base[u]) for u in base)
    for utt, x in want.items():
        assert sorted(got[utt]) == list(range(len(x)))
        shown = np.stack([x[:, 0], x[:, 1], x[:, -1], x[:, 1:] @ np.arange(1, x.shape[1])], axis=1)
        np.testing.assert_allclose(np.array([got[utt][i] for i in range(len(x))]), shown, atol=2e-4)


def test_many_voices_find_their_pitch_by_number(spark):
    """500 seeds with and without a gender: every result equals that of a run with its own setting alone."""
    from framewright.catalog.workflows import _pitch
    from framewright.plans import workflows as X

    rows = [(u, i, 0.0 if i % 5 == 0 else 90.0 + 3 * i + u, [float(i), u + 0.5], [-float(i), u + 1.5]) for u in (1, 2) for i in range(12)]
    all_ = spark.createDataFrame(rows, "utt_id bigint, frame bigint, f0 double, orig array<double>, syn array<double>")
    streams = [all_.select("utt_id", "frame", F.col(c).alias("vec")) for c in ("orig", "syn")]
    utts = spark.createDataFrame([(1, "a.wav"), (2, "b.wav")], "utt_id bigint, path string")
    pool, pitch = B.pool(spark, SF).cache(), _pitch(spark, SF).cache()

    def run(seeds, gender=None):
        grid = X.work_grid(utts, seeds, [0.4], gender, include_original=gender is None)
        out = X.anonymize(all_.select("utt_id", "frame", "f0"), *streams, pool, pitch, grid, gate=False)[0]
        return {(r["result"], r["frame"]): (r["f0"], tuple(r["vec"])) for r in out.collect()}

    many = run(list(range(1000, 1500)))
    assert len(many) == 2 * 12 * 501
    for seed in (1000, 1234, 1499):
        alone = run([seed])
        assert len(alone) == 2 * 12 * 2 and all(many[key] == value for key, value in alone.items())


def test_frames_of_a_setting_do_not_move(spark):
    """The speakers' vectors reached the frames by a second shuffle, after the settings had multiplied them."""
    from __spark_entry__ import SMOKE_DIR, queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = queries()["P3_anonymize_recordings"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Generate explode" in plan and "Exchange hashpartitioning" not in plan[:plan.index("Generate explode")]
