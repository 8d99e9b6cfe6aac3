"""Span editing: word groups, frame spans, crossfades and splices."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.hooks import map_groups
from framewright.operators.scans import (
    BLOCK, attach, bounded_broadcast, number_rows, running_max, running_sum, scan, with_lag_lead, with_neighbours)
from framewright.operators.segments import FPS, cut_at_eos, frames_in_ranges
from framewright.session import materialize

GRAFT = 8  # default context and overlap in frames
DICTIONARY_LIMIT = 16 << 20  # bytes of terms, as rows of a hash table, that may be sent to every task


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


# ---------------------------------------------------------------- word groups


def group_consecutive(picked: DataFrame, keys="utt_id", idx: str = "word_idx", block: int = BLOCK) -> DataFrame:
    """keys, group_no, first, last, n_words: runs of consecutive picked indices."""
    keys = _keys(keys)
    rows = picked.select(*keys, idx).dropDuplicates()
    rows = running_sum(rows, keys, F.lit(1).cast("bigint"), "_rank", pos=idx, block=block)
    runs = rows.groupBy(*keys, (F.col(idx) - F.col("_rank")).alias("_run")).agg(
        F.min(idx).alias("first"), F.max(idx).alias("last"), F.count(F.lit(1)).alias("n_words"))
    runs = running_sum(runs, keys, F.lit(1).cast("bigint"), "group_no", pos="first", block=block)
    return runs.select(*keys, (F.col("group_no") - 1).alias("group_no"), "first", "last", "n_words")


def group_spans(groups: DataFrame, words: DataFrame, keys="utt_id") -> DataFrame:
    """Add the frame span [start_frame, end_frame) of each group of words."""
    keys = _keys(keys)
    head = words.select(*keys, F.col("word_idx").alias("first"), F.col("start").alias("_s"))
    tail = words.select(*keys, F.col("word_idx").alias("last"), F.col("end").alias("_e"))
    rows = groups.join(head, [*keys, "first"]).join(tail, [*keys, "last"])
    return rows.select(
        *groups.columns, F.greatest(F.bround(F.col("_s") * FPS, 0).cast("bigint"), F.lit(0)).alias("start_frame"),
        F.bround(F.col("_e") * FPS, 0).cast("bigint").alias("end_frame"))


def pair_replacements(groups: DataFrame, texts: DataFrame, keys="utt_id") -> DataFrame:
    """Give the k-th text (keys, k, text) to the k-th group.

    A key whose counts differ gives one error row instead of its groups.
    """
    keys = _keys(keys)
    counts = (
        groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"))
        .join(texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts")), keys, "full")
        .fillna(0, ["n_groups", "n_texts"])
    )
    good = counts.filter("n_groups = n_texts").select(*keys)
    paired = groups.join(good, keys).join(
        texts.select(*keys, F.col("k").alias("group_no"), "text"), [*keys, "group_no"])
    wrong = counts.filter("n_groups <> n_texts").select(
        *keys, F.concat(F.col("n_texts").cast("string"), F.lit(" texts for "),
                        F.col("n_groups").cast("string"), F.lit(" groups")).alias("error"))
    return paired.withColumn("error", F.lit(None).cast("string")).unionByName(wrong, allowMissingColumns=True)


def context_strings(words: DataFrame, groups: DataFrame, keys="utt_id") -> DataFrame:
    """Text before and after each group.

    The transcript is one string per recording, and every word knows its place in
    it, so a context is one cut: nothing is joined word by word for each group. A
    result holds the text around its group by definition. A group beyond the words has all
    of them before it.
    """
    keys = _keys(keys)
    size = F.coalesce(F.length("word") + 1, F.lit(0)).cast("bigint")  # a missing word leaves no blank
    placed = running_sum(words.select(*keys, "word_idx", "word"), keys, size, "_end", pos="word_idx")
    head = placed.select(*keys, F.col("word_idx").alias("first"), (F.col("_end") - size).alias("_start"))
    tail = placed.select(*keys, F.col("word_idx").alias("last"), "_end")
    texts = words.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("_text"))
    rows = groups.join(head, [*keys, "first"], "left").join(tail, [*keys, "last"], "left").join(texts, keys)
    whole = F.length("_text")
    before = F.substring(F.concat("_text", F.lit(" ")), F.lit(1), F.coalesce("_start", F.when(whole > 0, whole + 1).otherwise(0)).cast("int"))
    after = F.substring("_text", F.coalesce("_end", whole + 1).cast("int"), whole)
    # An end of 0 means that no word stands before or in the group: all text follows.
    after = F.when(F.col("_end") > 0, after).when(F.col("_end").isNull() | (whole == 0), "").otherwise(F.concat(F.lit(" "), F.col("_text")))
    return rows.select(*groups.columns, before.alias("prefix"), after.alias("suffix"))


def edit_transcript(words: DataFrame, spans: DataFrame, keys="utt_id") -> DataFrame:
    """Word rows of the edited transcript: keys, word_idx, word, replaced.

    ``spans`` has first, last and text; the text stands at the first index.
    """
    keys = _keys(keys)
    covered = spans.select(*keys, F.explode(F.sequence("first", "last")).alias("word_idx"))
    kept = words.select(*keys, "word_idx", "word").join(covered, [*keys, "word_idx"], "left_anti")
    new = spans.select(*keys, F.col("first").alias("word_idx"), F.col("text").alias("word"))
    return kept.withColumn("replaced", F.lit(False)).unionByName(new.withColumn("replaced", F.lit(True)))


def list_words(words: DataFrame, n: int | None = None) -> DataFrame:
    """Printable list of all words, or of the first ``n`` of each recording."""
    line = F.format_string("%5d | %s | %.2f -> %.2f", "word_idx", "word", "start", "end")
    listed = words if n is None else words.filter(F.col("word_idx") < n)
    return listed.select("utt_id", "word_idx", line.alias("line"))


def longest_word(words: DataFrame, keys="utt_id") -> DataFrame:
    """The longest word of each recording, the first one on ties."""
    best = F.max_by(F.struct("word_idx", "word"), F.struct(F.length("word"), -F.col("word_idx"))).alias("_b")
    return words.groupBy(*_keys(keys)).agg(best).select(*_keys(keys), "_b.word_idx", "_b.word")


def tag_entities(words: DataFrame, patterns: Sequence[tuple[str, str]] = (),
                 dictionary: DataFrame | None = None, keys="utt_id",
                 limit_bytes: int = DICTIONARY_LIMIT) -> DataFrame:
    """Word indices with a label, by regular expressions (label, pattern) and a dictionary (term, label).

    A dictionary term is one word or several with blanks between them. It matches
    neighbouring lower-cased words without outer punctuation. Of matches that overlap
    the leftmost counts, of those from one word the longest; all labels of a span that
    counts are given to each of its words. A dictionary above the limit is first cut
    down to the terms that occur, found map-side.
    """
    keys = _keys(keys)
    rows = words.select(*keys, "word_idx", "word")
    found = None
    if patterns:
        hits = F.array_compact(F.array(*[
            F.when(F.col("word").rlike(pattern), F.lit(label)) for label, pattern in patterns]))
        found = rows.select(*keys, "word_idx", "word", F.explode(hits).alias("label"))
    if dictionary is not None:
        term = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
        matches = _term_matches(rows.withColumn("term", F.coalesce(term, F.lit(""))), dictionary, keys, limit_bytes)
        inside = matches.withColumn("word_idx", F.explode(F.sequence("first", "last"))).select(*keys, "word_idx", "label")
        known = rows.join(inside, [*keys, "word_idx"]).select(*keys, "word_idx", "word", "label")
        found = known if found is None else found.unionByName(known)
    return found.distinct()


def _term_matches(rows: DataFrame, dictionary: DataFrame, keys: list[str], limit_bytes: int) -> DataFrame:
    """keys, first, last, label of the dictionary terms in ``rows`` (keys, word_idx, term), leftmost and longest first."""
    terms = dictionary.select(F.array_join(F.filter(F.split("term", r"\s+"), lambda x: x != ""), " ").alias("gram"), "label").filter("gram <> ''").distinct()
    terms = materialize(terms.withColumn("k", F.size(F.split("gram", " "))), "terms")  # measured, looked up and joined
    sizes = sorted(r["k"] for r in terms.select("k").distinct().collect())  # as many as terms have lengths
    longest = max(sizes, default=1)
    if longest > 1:
        # The words from here on; each length is looked up by its own gram, so a common first word pairs with nothing.
        ahead = with_neighbours(rows, keys, {"_next": lambda w: F.collect_list(F.struct("word_idx", "term")).over(w.rowsBetween(0, longest - 1))},
                                after=longest - 1, pos="word_idx")
        spans = ahead.select(*keys, F.col("word_idx").alias("first"), "_next", F.explode(F.array(*[F.lit(k) for k in sizes])).alias("k"))
        last = F.get("_next", F.col("k") - 1)["word_idx"]
        spans = spans.filter(last == F.col("first") + F.col("k") - 1).select(
            *keys, "first", "k", F.array_join(F.slice(F.col("_next.term"), F.lit(1), F.col("k")), " ").alias("gram"))
    else:
        spans = rows.select(*keys, F.col("word_idx").alias("first"), F.lit(1).alias("k"), F.col("term").alias("gram"))
    size = 2 * F.octet_length("gram") + 160  # the gram stands in the key and in the row
    table = bounded_broadcast(terms, size, limit_bytes)
    if table is terms:
        used = materialize(spans.select("k", "gram").distinct().join(terms, ["k", "gram"]), "used-terms")
        table = bounded_broadcast(used, size, limit_bytes)
    matches = spans.join(table, ["k", "gram"]).select(*keys, "first", (F.col("first") + F.col("k") - 1).alias("last"), "label")
    if longest == 1:
        return matches
    matches = materialize(matches, "term-matches")
    return matches.join(_leftmost(matches.groupBy(*keys, "first").agg(F.max("last").alias("last")), keys), [*keys, "first", "last"])


def _leftmost(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans (keys, first, last; one per first) those that a walk from the left takes without overlap.

    Only spans that overlap directly or through others are walked together.
    """
    names = [*keys, "first", "last"]
    placed = scan(spans, keys, maxima={"_far": F.col("last")}, pos="first", inclusive=False)
    fresh = F.when(F.col("_far").isNull() | (F.col("first") > F.col("_far")), 1).otherwise(0).cast("bigint")
    placed = materialize(running_sum(placed, keys, fresh, "_cluster", pos="first").select(*names, "_cluster"), "term-clusters")
    many = placed.groupBy(*keys, "_cluster").agg(F.count(F.lit(1)).alias("_n"))
    sized = placed.join(many, [*keys, "_cluster"])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, free = None, None
        for batch in batches:
            if not len(batch):
                continue
            fresh = np.zeros(len(batch), dtype=bool)
            for key in [*keys, "_cluster"]:
                column = batch[key].to_numpy()
                fresh[1:] |= column[1:] != column[:-1]
            now = tuple(batch[key].iloc[0] for key in [*keys, "_cluster"])
            fresh[0], before = now != before, tuple(batch[key].iloc[-1] for key in [*keys, "_cluster"])
            taken = np.zeros(len(batch), dtype=bool)
            for i, (new, first, last) in enumerate(zip(fresh.tolist(), batch["first"].tolist(), batch["last"].tolist(), strict=True)):
                if new or first > free:
                    taken[i], free = True, last
            yield batch[taken][names]

    by = [*keys, "_cluster"]
    many = sized.filter("_n > 1").select(*names, "_cluster").repartition(*by).sortWithinPartitions(*by, "first")
    walked = many.mapInPandas(walk, placed.select(*names).schema)
    return sized.filter("_n = 1").select(*names).unionByName(walked)


# ---------------------------------------------------------------- crossfades and splices


def extend_chunk(df: DataFrame, prlen: Column, polen: Column, n_frames: Column, c: int = GRAFT,
                 marker: Column | None = None, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Cut the generated piece out of its context, ``c`` frames wider on each side.

    The piece is renumbered from 0 and ends before the first marked frame.
    """
    start = F.greatest(prlen - c, F.lit(0))
    stop = F.least(n_frames, n_frames - polen + c)
    rows = df.filter((F.col("frame") >= start) & (F.col("frame") < stop)).withColumn(
        "frame", F.col("frame") - start)
    return rows if marker is None else cut_at_eos(rows, marker, keys, block)


def _lengths(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("frame") + 1).alias(name))


def crossfade_append(a: DataFrame, b: DataFrame, width: int = GRAFT, keys="utt_id",
                     block: int = BLOCK) -> DataFrame:
    """Append ``b`` to ``a`` (keys, frame, f0, vec), blending ``width`` frames at the seam.

    The result is shorter than both together by the width, which the shorter
    side limits. Vectors follow a linear ramp, F0 is the plain mean.
    """
    keys = _keys(keys)
    lengths = _lengths(a, keys, "_na").join(_lengths(b, keys, "_nb"), keys, "full").fillna(0, ["_na", "_nb"])
    lengths = lengths.withColumn("_w", F.least(F.lit(width), F.col("_na"), F.col("_nb")))
    left = attach(a, lengths, keys, block=block).select(
        *keys, "frame", "_na", "_w", F.struct("f0", "vec").alias("_a"))
    right = attach(b, lengths, keys, block=block).select(
        *keys, (F.col("_na") - F.col("_w") + F.col("frame")).alias("frame"),
        (F.col("frame") + 1).alias("_i"), F.col("_w").alias("_wb"), F.struct("f0", "vec").alias("_b"))
    both = left.join(right, [*keys, "frame"], "full")
    ramp = _seam_share(F.col("_i"), F.col("_wb"))
    seam = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    vec = F.when(seam, F.zip_with("_a.vec", "_b.vec", lambda x, y: x * (1 - ramp) + y * ramp)).otherwise(
        F.coalesce("_a.vec", "_b.vec"))
    f0 = F.when(seam, F.col("_a.f0") * 0.5 + F.col("_b.f0") * 0.5).otherwise(F.coalesce("_a.f0", "_b.f0"))
    return both.select(*keys, "frame", f0.alias("f0"), vec.alias("vec"))


def graft_splice(base: DataFrame, repl: DataFrame, spans: DataFrame, k: int = GRAFT, keys="utt_id",
                 block: int = BLOCK) -> DataFrame:
    """Replace the span [start_frame, end_frame) by ``repl`` with a crossfade at both seams.

    One span per key; keys without a span are not part of the result. ``k=0`` is a hard cut.
    """
    keys = _keys(keys)
    rows = attach(base.select(*keys, "frame", "f0", "vec"),
                  spans.select(*keys, "start_frame", "end_frame"), keys, block=block)
    before = rows.filter("frame < start_frame").select(*keys, "frame", "f0", "vec")
    after = rows.filter("frame >= end_frame").select(
        *keys, (F.col("frame") - F.col("end_frame")).alias("frame"), "f0", "vec")
    piece = repl.select(*keys, "frame", "f0", "vec")
    return crossfade_append(crossfade_append(before, piece, k, keys, block), after, k, keys, block)


def hard_splice(base: DataFrame, repl: DataFrame, spans: DataFrame, keys="utt_id") -> DataFrame:
    """Replace the span without blending."""
    return graft_splice(base, repl, spans, 0, keys)


def _seam_share(step, width):
    """Share of the right side at the ``step``-th (from 1) of ``width`` shared frames."""
    return step / (width + 1)


def _joined(left: tuple, right: tuple, width: int) -> tuple:
    """Two pieces (f0, vectors) on one axis, overlapping by at most ``width`` frames.

    Every output frame is a weighted sum of both sides, each laid out with zeros
    where it has no frame; vectors take the seam's ramp as weight, F0 one half.
    """
    n_left, n_right = len(left[0]), len(right[0])
    shared = max(0, min(width, n_left, n_right))
    offset = n_left - shared
    at = np.arange(offset + n_right)
    share = np.clip(_seam_share(at - offset + 1, shared), 0.0, 1.0)
    half = 0.5 * (at >= offset) + 0.5 * (at >= n_left)
    out = []
    for a, b, weight in ((left[0], right[0], half), (left[1], right[1], share[:, None])):
        total = np.zeros((len(at), *a.shape[1:]))
        total[:n_left] += (1.0 - weight[:n_left]) * a
        total[offset:] += weight[offset:] * b
        out.append(total)
    return tuple(out)


def _fold_cluster(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """Apply the splices of one cluster, last to first, on its own frames; rows come sorted by kind, rank and frame."""
    kind, rank, starts, ends, f0, vecs = (pdf[c].to_numpy() for c in ("kind", "rank", "s", "e", "f0", "vec"))
    first, orders = np.searchsorted(kind, [1, 2])
    dim = next((len(v) for v in vecs if v is not None), 0)

    def piece(a, b):
        return f0[a:b].astype(np.float64), np.stack(vecs[a:b]) if b > a else np.zeros((0, dim))

    now, empty = piece(0, first), (np.zeros(0), np.zeros((0, dim)))
    cuts = [first, *(np.flatnonzero(np.diff(rank[first:orders])) + first + 1), orders]
    pieces = {rank[a]: (a, b) for a, b in zip(cuts, cuts[1:]) if b > a}
    for i in range(len(kind) - 1, orders - 1, -1):
        s, e = max(int(starts[i]), 0), max(int(ends[i]), 0)
        head, tail = (now[0][:s], now[1][:s]), (now[0][e:], now[1][e:])
        new = piece(*pieces[rank[i]]) if rank[i] in pieces else empty
        now = _joined(_joined(head, new, k), tail, k)
    n = len(now[0])
    return pd.DataFrame({"utt_id": pdf["utt_id"].iloc[0], "cluster": pdf["cluster"].iloc[0],
                         "frame": np.arange(n), "f0": now[0], "vec": list(now[1])})


def _cluster_ops(ops: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """Number the splices of each recording and cut them into clusters that cannot touch each other.

    A splice reads at most ``k`` frames before its start. To its right it needs
    ``k`` frames that later splices may shorten; the need carries over like a
    queue, need' = max(k, need + k - gap), which is a running sum minus its
    running minimum. A cluster ends where the next start lies beyond the need.
    """
    ranked = number_rows(ops, ["start_frame", -F.col("op")], ["utt_id"], out="rank")
    ranked = with_lag_lead(ranked, "utt_id", lag={"_before": "end_frame"}, pos="rank")
    debt = F.when(F.col("rank") == 0, 0).otherwise(k - (F.col("start_frame") - F.col("_before")))
    ranked = running_sum(ranked, "utt_id", debt, "_debt", pos="rank")
    ranked = running_max(
        ranked, "utt_id", {"_floor": -F.col("_debt"), "_far": F.col("end_frame")}, pos="rank")
    ranked = materialize(
        ranked.withColumn("_reach", F.col("_far") + k + F.col("_debt") + F.col("_floor")), "splice-reach")
    ranked = with_lag_lead(ranked, "utt_id", lag={"_open": "_reach"}, pos="rank")
    fresh = F.when((F.col("rank") == 0) | (F.col("start_frame") - k >= F.col("_open")), 1).otherwise(0)
    ranked = running_sum(ranked, "utt_id", fresh, "cluster", pos="rank")
    windows = ranked.groupBy("utt_id", "cluster").agg(
        F.greatest(F.min("start_frame") - k, F.lit(0)).alias("f0"), F.max("_reach").alias("_to"))
    windows = windows.join(lengths, "utt_id").select(
        "utt_id", "cluster", "f0", F.greatest(F.least("_to", "_n"), F.col("f0")).alias("f1"))
    return ranked.select("utt_id", "rank", "op", "start_frame", "end_frame", "cluster").join(
        windows, ["utt_id", "cluster"])


def _new_length(k: int) -> Column:
    """Length of a cluster after its splices, from the lengths alone."""
    zero = F.lit(0).cast("bigint")

    def step(size, op):
        before = F.least(op["s"], size)
        after = F.greatest(size - op["e"], zero)
        first = F.least(F.lit(k).cast("bigint"), before, op["n"])
        joined = before + op["n"] - first
        return joined + after - F.least(F.lit(k).cast("bigint"), joined, after)

    return F.aggregate("_ops", F.col("f1") - F.col("f0"), step)


def apply_splices(
    base: DataFrame, ops: DataFrame, repl: DataFrame, k: int = GRAFT,
    convert: Callable[[DataFrame], DataFrame] | None = None, block: int = BLOCK,
) -> DataFrame:
    """Apply several splices per recording as if done from the last span to the first.

    ``base``: utt_id, frame, f0, vec. ``ops``: utt_id, op, start_frame,
    end_frame. ``repl``: utt_id, op, frame, f0, vec; ``convert`` may change its
    pitch first. Only splices whose seams are close interact, so recordings are
    cut into clusters of such splices; each cluster folds its own few frames and
    all other frames just move.
    """
    if convert is not None:
        repl = materialize(convert(repl), "splice-pieces")  # measured, then placed
    ops = materialize(ops.select("utt_id", "op", "start_frame", "end_frame"), "splice-orders")
    lengths = base.groupBy("utt_id").agg((F.max("frame") + 1).alias("_n"))
    placed = _cluster_ops(ops.withColumn("start_frame", F.greatest("start_frame", F.lit(0))), lengths, k)
    sizes = repl.groupBy("utt_id", "op").agg((F.max("frame") + 1).alias("_r"))
    placed = placed.join(sizes, ["utt_id", "op"], "left").fillna(0, ["_r"]).withColumn(
        "s", F.col("start_frame") - F.col("f0")).withColumn("e", F.col("end_frame") - F.col("f0"))
    placed = materialize(placed, "splice-clusters")

    clusters = placed.groupBy("utt_id", "cluster", "f0", "f1").agg(F.reverse(F.array_sort(F.collect_list(
        F.struct("rank", "s", "e", F.col("_r").alias("n"))))).alias("_ops"))
    clusters = clusters.select("utt_id", "cluster", "f0", "f1", (_new_length(k) - (F.col("f1") - F.col("f0"))).alias("_grow"))
    clusters = materialize(
        running_sum(clusters, "utt_id", F.col("_grow"), "_shift", pos="cluster", inclusive=False, block=block), "splice-shifts")

    # The frames between two clusters all move by what the clusters before them grew,
    # so clusters and gaps are one small table of ranges that the frames meet once.
    following = with_lag_lead(clusters, "utt_id", lead={"_next": "f0"}, pos="cluster", block=block).join(lengths, "utt_id")
    gaps = following.select(
        "utt_id", F.lit(None).cast("bigint").alias("cluster"), F.col("f1").alias("f0"), F.coalesce("_next", "_n").alias("f1"),
        (F.col("_shift") + F.col("_grow")).alias("_move"))
    ranges = clusters.select("utt_id", "cluster", "f0", "f1", F.lit(None).cast("bigint").alias("_move")).unionByName(gaps)
    frames = base.select("utt_id", "frame", F.col("f0").alias("_f0"), "vec")
    ranged = frames_in_ranges(frames, materialize(ranges, "splice-ranges"), how="left")
    outside = ranged.filter("cluster is null").select(
        "utt_id", (F.col("frame") + F.coalesce("_move", F.lit(0))).alias("frame"), F.col("_f0").alias("f0"), "vec")

    def rows(df, kind, frame, f0, vec, s, e, rank):
        return df.select("utt_id", "cluster", F.lit(kind).alias("kind"), frame.cast("bigint").alias("frame"),
                         f0.cast("double").alias("f0"), vec.cast("array<double>").alias("vec"),
                         s.cast("bigint").alias("s"), e.cast("bigint").alias("e"), rank.cast("bigint").alias("rank"))

    none = F.lit(None)
    inside = rows(ranged.filter("cluster is not null"), 0, F.col("frame") - F.col("f0"), F.col("_f0"),
                  F.col("vec"), none, none, none)
    pieces = repl.select("utt_id", "op", "frame", "f0", "vec").join(
        placed.select("utt_id", "op", "cluster", "rank"), ["utt_id", "op"])
    pieces = rows(pieces, 1, F.col("frame"), F.col("f0"), F.col("vec"), none, none, F.col("rank"))
    orders = rows(placed, 2, none, none, none, F.col("s"), F.col("e"), F.col("rank"))
    folded = map_groups(
        inside.unionByName(pieces).unionByName(orders), ["utt_id", "cluster"], ["kind", "rank", "frame"],
        lambda pdf: _fold_cluster(pdf, k), "utt_id bigint, cluster bigint, frame bigint, f0 double, vec array<double>")
    folded = folded.join(
        clusters.select("utt_id", "cluster", (F.col("f0") + F.col("_shift")).alias("_at")), ["utt_id", "cluster"])
    return outside.unionByName(
        folded.select("utt_id", (F.col("_at") + F.col("frame")).alias("frame"), "f0", "vec"))
