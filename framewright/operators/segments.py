"""Segments, words, alignments and frame windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import rng
from framewright.functions.text import strip, words_of
from framewright.operators.hooks import map_groups
from framewright.operators.scans import (
    BLOCK, attach, running_last, running_sum, scan, with_lag_lead, with_totals)
from framewright.session import materialize

FPS = 50


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ---------------------------------------------------------------- greedy merge


def _next_starts(pdf: pd.DataFrame, block: int, min_words: int, min_chars: int) -> pd.DataFrame:
    """For each segment of one block: where the group that starts there ends, and
    the first group start at or past the end of the block."""
    seg = pdf["seg"].to_numpy()
    total = int(pdf["n_seg"].iloc[0])
    home = int((seg // block == pdf["blk"].iloc[0]).sum())
    n_words, stripped = pdf["n_words"].to_numpy(), pdf["n_strip"].to_numpy()
    words, raw = n_words[:home].copy(), pdf["n_raw"].to_numpy()[:home].copy()
    inner = stripped[:home].copy()
    last = np.arange(home)
    open_ = (words < min_words) | (raw < min_chars)
    while True:
        grow = np.flatnonzero(open_ & (last + 1 < len(seg)))
        if not len(grow):
            break
        last[grow] += 1
        j = last[grow]
        words[grow] += n_words[j]
        raw[grow] = inner[grow] + 1 + stripped[j]
        inner[grow] = np.where(stripped[j] == 0, inner[grow],
                               np.where(inner[grow] == 0, stripped[j], raw[grow]))
        open_[grow] = (words[grow] < min_words) | (raw[grow] < min_chars)
    nxt = seg[last] + 1
    settled = ~open_ | (nxt >= total)
    leave = nxt.copy()
    first = seg[0]
    for i in range(home - 1, -1, -1):
        if nxt[i] < first + home:
            leave[i] = leave[nxt[i] - first]
    return pd.DataFrame({"utt_id": pdf["utt_id"].iloc[0], "blk": pdf["blk"].iloc[0],
                         "seg": seg[:home], "nxt": nxt, "leave": leave, "settled": settled})


def _reached(hops: DataFrame) -> DataFrame:
    """(utt_id, entry): the doors on the way from segment 0, by pointer doubling.

    ``hops``: utt_id, seg, leave of every door. In round k a hop spans 2**k doors and
    all doors before that distance are marked; each round doubles both, so the
    rounds grow with the logarithm of the longest way and no task holds a way.
    """
    reached = hops.filter("seg = 0").select("utt_id", "seg")
    doors = hops.select("utt_id", F.col("seg").alias("leave"))
    hop = materialize(hops.join(doors, ["utt_id", "leave"]).select("utt_id", "seg", "leave"), "hops")
    while not hop.isEmpty():
        further = reached.join(hop, ["utt_id", "seg"]).select("utt_id", F.col("leave").alias("seg"))
        reached = materialize(reached.unionByName(further), "reached")
        beyond = hop.select("utt_id", F.col("seg").alias("leave"), F.col("leave").alias("_to"))
        hop = materialize(hop.join(beyond, ["utt_id", "leave"]).select("utt_id", "seg", F.col("_to").alias("leave")), "hops")
    return reached.withColumnRenamed("seg", "entry")


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Group starts inside one block, from its entry point on."""
    hop = dict(zip(pdf["seg"], pdf["nxt"]))
    first, last, at = [], [], int(pdf["entry"].iloc[0])
    while at in hop:
        first.append(at)
        last.append(hop[at] - 1)
        at = hop[at]
    return pd.DataFrame({"utt_id": pdf["utt_id"].iloc[0], "first_seg": first, "last_seg": last})


def merge_segments(segs: DataFrame, min_words: int = 30, min_chars: int = 70,
                   block: int = 8192, halo: int = 256) -> DataFrame:
    """Merge neighbouring segments until both thresholds are met; the last group may stay short.

    ``segs``: utt_id, seg (dense from 0), start, end, text, words. Where a group
    ends depends only on where it starts, so blocks of segments are solved for
    every possible start, pointer doubling over the hops between blocks finds the
    doors that are entered, and only then the real groups are read off. No recording is
    folded or walked in one piece. Blocks with a group that outgrows the halo are
    solved again with twice the halo.
    """
    sizes = with_totals(
        segs.select("utt_id", "seg", F.size("words").alias("n_words"), F.length("text").alias("n_raw"),
                    F.length(strip(F.col("text"))).alias("n_strip")),
        "utt_id", [(F.max("seg") + 1).alias("n_seg")], pos="seg", block=block)
    done = todo = None
    while True:
        reach = sizes.withColumn("blk", F.explode(F.sequence(
            F.expr(f"greatest(seg - {halo}, 0) div {block}"), F.expr(f"seg div {block}"))))
        if todo is not None:  # only the blocks whose groups outgrew the last halo
            reach = reach.join(todo, ["utt_id", "blk"], "left_semi")
        jumps = materialize(
            map_groups(
                reach, ["utt_id", "blk"], ["seg"], lambda pdf: _next_starts(pdf, block, min_words, min_chars),
                "utt_id bigint, blk bigint, seg bigint, nxt bigint, leave bigint, settled boolean"),
            "merge-jumps")
        open_blocks = jumps.filter(~F.col("settled")).select("utt_id", "blk").distinct()
        settled = jumps.join(open_blocks, ["utt_id", "blk"], "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if open_blocks.isEmpty():
            break
        todo, halo = open_blocks, 2 * halo
    jumps = done
    doors = jumps.select("utt_id", F.col("leave").alias("seg")).unionByName(
        jumps.filter("seg = 0").select("utt_id", "seg")).distinct()
    entries = _reached(materialize(doors.join(jumps.select("utt_id", "seg", "leave"), ["utt_id", "seg"]), "doors"))
    groups = map_groups(
        jumps.join(entries.withColumn("blk", F.expr(f"entry div {block}")), ["utt_id", "blk"]),
        ["utt_id", "blk"], ["seg"], _starts, "utt_id bigint, first_seg bigint, last_seg bigint")
    members = groups.withColumn("seg", F.explode(F.sequence("first_seg", "last_seg"))).join(
        segs, ["utt_id", "seg"])
    parts = members.groupBy("utt_id", "first_seg", "last_seg").agg(
        F.array_sort(F.collect_list(F.struct("seg", "start", "end", "text", "words"))).alias("p"))
    text = F.aggregate(
        F.slice("p", 2, F.size("p")), F.col("p")[0]["text"],
        lambda acc, x: F.concat(strip(acc), F.lit(" "), strip(x["text"])))
    return parts.select(
        "utt_id", "first_seg", "last_seg", F.col("p")[0]["start"].alias("start"),
        F.element_at("p", -1)["end"].alias("end"), text.alias("text"),
        F.flatten(F.col("p.words")).alias("words"))


# ---------------------------------------------------------------- segments and frames


def segment_frames(segs: DataFrame, utts: DataFrame) -> DataFrame:
    """utt_id, seg, f0, f1: frame range of each segment, clamped; empty ranges are dropped.

    ``utts`` has utt_id, duration (s) and n_frames.
    """
    rows = attach(segs.select("utt_id", "seg", "start", "end"),
                  utts.select("utt_id", "duration", "n_frames"), "utt_id", pos="seg")
    start = F.bround(F.col("start") / F.col("duration") * F.col("n_frames"), 0).cast("bigint")
    end = F.bround(F.col("end") / F.col("duration") * F.col("n_frames"), 0).cast("bigint")
    ranged = rows.select("utt_id", "seg", F.greatest(start, F.lit(0)).alias("f0"),
                         F.least(end, F.col("n_frames")).alias("f1"))
    return ranged.filter("f0 < f1")


def frames_in_ranges(frames: DataFrame, ranges: DataFrame, keys="utt_id", how: str = "inner",
                     width: int = 1024) -> DataFrame:
    """Frames joined to the ranges [f0, f1) that hold them.

    Both sides carry a bucket of ``width`` frames, so the join is on
    (key, bucket) and a long recording with many ranges does not pair them all.
    """
    keys = _keys(keys)
    cut = ranges.filter("f0 < f1").withColumn("_w", F.explode(F.sequence(
        F.expr(f"greatest(f0, 0) div {width}"), F.expr(f"(f1 - 1) div {width}"))))
    left, right = frames.withColumn("_w", F.expr(f"frame div {width}")).alias("l"), cut.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_w"]]
    on += [F.col("l.frame") >= F.col("r.f0"), F.col("l.frame") < F.col("r.f1")]
    joined = left.join(right, on, how)
    return joined.select(
        *[F.col(f"l.{c}").alias(c) for c in frames.columns],
        *[F.col(f"r.{c}").alias(c) for c in ranges.columns if c not in keys])


def frames_in_segments(frames: DataFrame, ranges: DataFrame, keys="utt_id") -> DataFrame:
    """Frames of each segment with their offset inside it."""
    return frames_in_ranges(frames, ranges, keys).withColumn("offset", F.col("frame") - F.col("f0"))


def overlay_segments(base: DataFrame, generated: DataFrame, ranges: DataFrame, value: str,
                     keys="utt_id") -> DataFrame:
    """Generated rows (keys, seg, i, value) replace base rows inside their range.

    The shorter of piece and range counts; where ranges overlap the later
    segment wins. Generated rows are dealt out by their number before they are joined, because a few
    packed rows of pieces may have grown to many in one task.
    """
    keys = _keys(keys)
    placed = generated.repartition(*keys, "seg").join(ranges, [*keys, "seg"]).withColumn("frame", F.col("f0") + F.col("i"))
    placed = placed.filter("frame < f1").groupBy(*keys, "frame").agg(F.max_by(value, "seg").alias("_new"))
    return base.join(placed, [*keys, "frame"], "left").withColumn(
        value, F.coalesce("_new", value)).drop("_new")


# ---------------------------------------------------------------- alignments


def alignment_runs(frames: DataFrame, blank: int, keys="utt_id", value: str = "phone",
                   block: int = BLOCK) -> DataFrame:
    """keys, run, phone, start, end: runs of equal non-blank ids.

    The first run starts at 0, every run lasts until the next one begins and
    the last one until the end of the sequence.
    """
    keys = _keys(keys)
    seen = F.when(F.col(value) != blank, F.col(value))
    rows = scan(frames.select(*keys, "frame", value), keys, lasts={"_prev": seen},
                totals={"_n": ("max", F.col("frame") + 1)}, block=block, inclusive=False)
    changes = rows.filter((F.col(value) != blank) & ~F.col("_prev").eqNullSafe(F.col(value)))
    runs = running_sum(changes, keys, F.lit(1).cast("bigint"), "run", block=block).withColumn(
        "run", F.col("run") - 1)
    runs = with_lag_lead(runs, keys, lead={"_next": "frame"}, pos="run", block=block)
    return runs.select(
        *keys, "run", F.col(value).alias("phone"),
        F.when(F.col("run") == 0, 0).otherwise(F.col("frame")).alias("start"),
        F.coalesce("_next", "_n").alias("end"))


def ctc_hold(frames: DataFrame, blank: int, keys="utt_id", value: str = "phone",
             block: int = BLOCK) -> DataFrame:
    """Blank frames keep the last symbol; before the first symbol it is 0."""
    kept = F.when(F.col(value) != blank, F.col(value))
    out = running_last(frames, keys, kept, "held", block=block)
    return out.withColumn("held", F.coalesce("held", F.lit(0)))


def word_bounds(durs: DataFrame, keys="utt_id", separator: int = 0, block: int = BLOCK) -> DataFrame:
    """keys, word_no, x0, x1: frame bounds of the words between separators.

    A word runs from behind one separator to the start of the next; what lies
    before the first and behind the last one is not a word.
    """
    keys = _keys(keys)
    summed = running_sum(durs.select(*keys, "pos", "symbol_id", "dur"), keys, F.col("dur"), "_after",
                         pos="pos", block=block)
    seps = summed.filter(F.col("symbol_id") == separator).withColumn(
        "_before", F.col("_after") - F.col("dur"))
    seps = running_sum(seps, keys, F.lit(1).cast("bigint"), "word_no", pos="pos", block=block) \
        .withColumn("word_no", F.col("word_no") - 1)
    seps = with_lag_lead(seps, keys, lead={"x1": "_before"}, pos="word_no", block=block)
    return seps.filter("x1 is not null").select(*keys, "word_no", F.col("_after").alias("x0"), "x1")


def word_timestamps(bounds: DataFrame, segs: DataFrame) -> DataFrame:
    """utt_id, seg, word_no, word, start, end in seconds.

    ``bounds``: utt_id, seg, word_no, x0, x1. Words and bounds pair by position;
    what the longer side has more is left out.
    """
    words = segs.select("utt_id", "seg", F.col("start").alias("_s"),
                        F.posexplode(words_of(F.col("text"))).alias("word_no", "word"))
    return words.join(bounds, ["utt_id", "seg", "word_no"]).select(
        "utt_id", "seg", "word_no", "word",
        (F.col("_s") + (F.col("x0") - 3) / F.lit(float(FPS))).alias("start"),
        (F.col("_s") + (F.col("x1") + 1.5) / F.lit(float(FPS))).alias("end"))


def expand_by_duration(df: DataFrame, keys="utt_id", dur: str = "dur", scale: float = 1.0,
                       block: int = BLOCK) -> DataFrame:
    """Repeat each row round(dur * scale) times and number the result as ``frame``."""
    times = F.bround(F.col(dur) * F.lit(scale), 0).cast("bigint")
    rows = running_sum(df.withColumn("_times", times), keys, F.col("_times"), "_at", pos="pos",
                       block=block, inclusive=False)
    rows = rows.filter("_times > 0").withColumn(
        "_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
    return rows.withColumn("frame", F.col("_at") + F.col("_i")).drop("_times", "_at", "_i")


def context_frames(durs: DataFrame, n_prefix: Column, n_postfix: Column, keys="utt_id",
                   block: int = BLOCK) -> DataFrame:
    """Total duration of the leading and trailing context symbols.

    A context of n symbols covers n + 1, as its boundary symbol counts. A
    zero trailing total means nothing is cut.
    """
    keys = _keys(keys)
    rows = durs.withColumn("_np", n_prefix + 1).withColumn("_nq", n_postfix + 1)
    rows = with_totals(rows, keys, [F.min("pos").alias("_lo"), F.max("pos").alias("_hi")], pos="pos",
                       block=block)
    rows = rows.withColumn("_idx", F.col("pos") - F.col("_lo"))
    size = F.col("_hi") - F.col("_lo") + 1
    return rows.groupBy(*keys).agg(
        F.sum(F.when(F.col("_idx") < F.col("_np"), F.col("dur")).otherwise(0)).alias("prefix_frames"),
        F.sum(F.when(F.col("_idx") >= size - F.col("_nq"), F.col("dur")).otherwise(0)).alias("postfix_frames"))


# ---------------------------------------------------------------- ends, chunks, crops


def trim_tail(df: DataFrame, nonzero: Column, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Drop the rows behind the last non-zero one; an all-zero sequence stays whole."""
    rows = with_totals(df, keys, [F.max(F.when(nonzero, F.col("frame"))).alias("_last")], block=block)
    return rows.filter(F.col("_last").isNull() | (F.col("frame") <= F.col("_last"))).drop("_last")


def mask_after_eos(df: DataFrame, eos: int, value: str = "code", mask: int = -1, keep_eos: bool = True,
                   keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Set everything behind the first end marker (or from it on) to ``mask``."""
    rows = with_totals(df, keys, [F.min(F.when(F.col(value) == eos, F.col("frame"))).alias("_eos")], block=block)
    hit = F.col("frame") > F.col("_eos") if keep_eos else F.col("frame") >= F.col("_eos")
    return rows.withColumn(value, F.when(hit, mask).otherwise(F.col(value))).drop("_eos")


def append_eos(df: DataFrame, eos: int, value: str = "code", keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Add one position per key and put the end marker behind the last non-zero value."""
    keys = _keys(keys)
    rows = df.select(*keys, "frame", value)
    extra = rows.groupBy(*keys).agg((F.max("frame") + 1).alias("frame")).withColumn(
        value, F.lit(0).cast(df.schema[value].dataType))
    rows = with_totals(rows.unionByName(extra), keys,
                       [F.max(F.when(F.col(value) != 0, F.col("frame"))).alias("_last")], block=block)
    at = F.coalesce(F.col("_last") + 1, F.lit(0))
    return rows.withColumn(value, F.when(F.col("frame") == at, eos).otherwise(F.col(value))).drop("_last")


def cut_at_eos(df: DataFrame, marker: Column, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Keep the rows before the first marked frame."""
    rows = with_totals(df, keys, [F.min(F.when(marker, F.col("frame"))).alias("_eos")], block=block)
    return rows.filter(F.col("_eos").isNull() | (F.col("frame") < F.col("_eos"))).drop("_eos")


def unique_consecutive(df: DataFrame, value: str = "code", keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Keep the first row of each run of equal values."""
    rows = with_lag_lead(df.withColumn("_has", F.lit(True)), keys, lag={"_prev": value, "_had": "_has"}, block=block)
    return rows.filter(F.col("_had").isNull() | ~F.col("_prev").eqNullSafe(F.col(value))).drop("_prev", "_had", "_has")


def chunk_frames(df: DataFrame, size: int = 128, pad=0, value: str = "code", group: int = 32,
                 keys="utt_id") -> DataFrame:
    """Fixed-length chunks: chunk_group, chunk, pos, value; the last chunk is filled with ``pad``."""
    keys = _keys(keys)
    rows = df.select(*keys, "frame", value)
    ends = rows.groupBy(*keys).agg((F.max("frame") + 1).alias("_n")).filter(F.col("_n") % size != 0)
    fill = ends.withColumn("frame", F.explode(F.sequence(
        F.col("_n"), F.expr(f"((_n - 1) div {size} + 1) * {size} - 1")))).select(
        *keys, "frame", F.lit(pad).cast(df.schema[value].dataType).alias(value))
    chunk = F.expr(f"frame div {size}")
    return rows.unionByName(fill).select(
        *keys, F.expr(f"frame div {size} div {group}").alias("chunk_group"), chunk.alias("chunk"),
        (F.col("frame") % size).alias("pos"), value)


def curtail(df: DataFrame, k: int, from_left: bool = False, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Cut each sequence to a multiple of ``k``, at its end or (``from_left``) at its start."""
    rows = with_totals(df, keys, [F.count(F.lit(1)).alias("_n")], block=block)
    kept = F.expr(f"_n div {k} * {k}")
    cond = F.col("frame") >= F.col("_n") - kept if from_left else F.col("frame") < kept
    return rows.filter(cond).drop("_n")


def truncate_to(df: DataFrame, lengths: DataFrame, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Cut each sequence to its target length (keys, n_target)."""
    return attach(df, lengths, keys, block=block).filter("frame < n_target").drop("n_target")


def align_min(a: DataFrame, b: DataFrame, keys="utt_id") -> DataFrame:
    """Pair two sequences frame by frame up to the shorter one."""
    return a.join(b, [*_keys(keys), "frame"])


def crop_streams(lead: DataFrame, codes: DataFrame, f0: DataFrame, max_len: int, keys="utt_id",
                 block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crop long recordings: ``max_len`` rows of lead and codes, the proportional part of F0."""
    keys = _keys(keys)
    sizes = (
        lead.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
        .join(codes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nc")), keys)
        .join(f0.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nf")), keys)
    )
    whole = F.col("_nl") <= max_len
    part = F.floor(F.lit(float(max_len)) / F.col("_nc") * F.col("_nf"))
    limits = sizes.select(
        *keys, F.when(whole, F.col("_nl")).otherwise(max_len).alias("_l"),
        F.when(whole, F.col("_nc")).otherwise(max_len).alias("_c"),
        F.when(whole, F.col("_nf")).otherwise(part).alias("_f"))
    return tuple(
        truncate_to(df, limits.select(*keys, F.col(col).alias("n_target")), keys, block)
        for df, col in ((lead, "_l"), (codes, "_c"), (f0, "_f")))


def crop_starts(df: DataFrame, size: int, seed, keys="utt_id") -> DataFrame:
    """keys, n, start: a seeded crop start for each sequence; 0 if it is shorter than ``size``."""
    keys = _keys(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    room = F.col("n") - size + 1
    return sizes.withColumn("start", F.when(room > 1, F.floor(
        rng.uniform(seed, *[F.col(k) for k in keys], "crop") * room)).otherwise(0))


def random_crop(df: DataFrame, size: int, seed, value: str, keys="utt_id",
                starts: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``size`` rows from a seeded start, numbered from 0; short sequences are zero-padded."""
    keys = _keys(keys)
    starts = crop_starts(df, size, seed, keys) if starts is None else starts
    rows = attach(df.select(*keys, "frame", value), starts.select(*keys, "start"), keys, block=block)
    rows = rows.withColumn("frame", F.col("frame") - F.col("start")).filter(
        (F.col("frame") >= 0) & (F.col("frame") < size))
    have = F.least(F.col("n") - F.col("start"), F.lit(size))
    fill = starts.filter(have < size).withColumn(
        "frame", F.explode(F.sequence(have, F.lit(size - 1).cast("bigint")))).select(
        *keys, "frame", F.lit(0).cast(df.schema[value].dataType).alias(value))
    return rows.select(*keys, "frame", value).unionByName(fill)


def paired_crop(frames: DataFrame, samples: DataFrame, segment: int, hop: int, seed, frame_value: str,
                sample_value: str, keys="utt_id", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same random section of frames and of samples at ``hop`` samples per frame."""
    keys = _keys(keys)
    size = -(-segment // hop)
    starts = crop_starts(frames, size, seed, keys)
    counts = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sample_starts = starts.select(*keys, (F.col("start") * hop).alias("start")).join(counts, keys)
    return (random_crop(frames, size, seed, frame_value, keys, starts, block),
            random_crop(samples, segment, seed, sample_value, keys, sample_starts, block))
