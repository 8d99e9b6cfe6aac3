"""Exact dedup of repeated byte strings by bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
smaller document id, or earlier in the same document).

Windows of equal content must meet in one task without a global suffix array. Every
window of LENGTH bytes is named by its least hashed GRAM-byte substring (its anchor), so
equal windows share an anchor. Neighbouring windows with one anchor form a piece. Only
pieces whose anchor occurs twice anywhere are candidates; equal pieces collapse to their
first occurrence (a later one is a repeat as a whole). The distinct pieces are dealt by
anchor, and each task indexes blocks of whole anchors: it builds the Burrows-Wheeler
transform of the block and extends intervals backward, level by level, which derives the
common prefixes by increasing length and stops at LENGTH. Rows then not separated share
a window, and all but the earliest are repeats.

An anchor whose distinct pieces exceed ANCHOR_BYTES (a line or passage that very many
documents share in different surroundings) is opened into its windows, which are
grouped by a 128-bit hash with partial aggregation.

Defined cases: a null or empty text has no bytes; a text shorter than LENGTH loses
nothing; rows without an id come first and rows that share an id count as several
documents, both ordered by their text (equal rows keep one whole); an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import number_rows
from ..session import materialize
from .groups import few
from .words import Words, add_columns, mix64, sliced, small_batches, tidy

LENGTH, GRAM = 100, 24
#: Bytes of one block (or of the pieces of one anchor, up to the second bound), windows
#: of one piece, bytes of one slice of texts.
BLOCK_BYTES, ANCHOR_BYTES, PIECE_WINDOWS, SLICE = 1 << 18, 1 << 20, 512, 1 << 20
_N_BITS = 12


def released(df: DataFrame, label: str) -> DataFrame:
    """``materialize``, and let Spark delete the job's shuffle files when it has ended."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return materialize(df, label)
    finally:
        spark.conf.set(name, before)


def _slide(best: np.ufunc, values: np.ndarray, wide: int) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``wide`` neighbours, by doubling."""
    size = 1
    while size * 2 <= wide:
        values = best(values[:-size], values[size:])
        size *= 2
    return best(values[: size - wide], values[wide - size :]) if wide > size else values


class Pieces:
    """Cuts the windows of a slice of texts into pieces of one anchor."""

    def __init__(self):
        self.gram, self.whole = Words("solid", lower=False), Words("solid", lower=False)
        self.whole.code = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0xBEEF)) | np.uint64(1)
        self.whole.base = 0x2C1B3C6D297A2D35

    def _least(self, data: np.ndarray, offsets: np.ndarray):
        """Gram hashes, the least one of each window, and which windows lie inside one document."""
        at = np.arange(len(data) - GRAM + 1)
        grams = self.gram.hashes(data, at, at + GRAM)
        least = _slide(np.minimum, grams, LENGTH - GRAM + 1)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        end = offsets[doc + 1] - LENGTH + 1  # where the document's windows end
        return grams, least, doc, end, np.arange(len(least)) < end

    def anchors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The anchor hash of every place where a gram is the least of some window."""
        if len(data) < LENGTH:
            return np.empty(0, np.uint64)
        grams, least, _, _, inside = self._least(data, offsets)
        wide = LENGTH - GRAM + 1
        most = np.zeros(len(least) + 2 * (wide - 1), np.uint64)
        most[wide - 1 : len(least) + wide - 1] = np.where(inside, least, np.uint64(0))
        return grams[grams == _slide(np.maximum, most, wide)]

    def cut(self, data: np.ndarray, offsets: np.ndarray):
        """(document, start in it, windows, anchor) of each piece, in order."""
        none = np.empty(0, np.int64)
        if len(data) < LENGTH:
            return none, none, none, none.view(np.uint64)
        _, least, doc, end, inside = self._least(data, offsets)
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new & inside)
        edges = np.append(np.flatnonzero(new), len(least))
        windows = np.minimum(edges[np.searchsorted(edges, start, "right")], end[start]) - start
        long = -(-windows // PIECE_WINDOWS)
        if (long > 1).any():
            nth = np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
            start = np.repeat(start, long) + nth * PIECE_WINDOWS
            windows = np.minimum(np.repeat(windows, long) - nth * PIECE_WINDOWS, PIECE_WINDOWS)
        return doc[start], start - offsets[doc[start]], windows, least[start]

    def hashes(self, data: np.ndarray, start: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return self.whole.hashes(data, start, start + windows + LENGTH - 1)


def transform(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order up to ``depth`` bytes at least, Burrows-Wheeler transform)."""
    n, known = len(text), 8
    wide = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | wide[i : i + n].astype(np.uint64)
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.uint64)
    tied = np.arange(n)
    while True:
        # A row's rank is the first row of its ties, so rows that stand alone are done with.
        head = np.maximum.accumulate(np.where(new, tied, 0))
        rank[order[tied]] = head.astype(np.uint64)
        if known >= depth:
            break
        alone = new.copy()
        alone[:-1] &= new[1:]
        tied, head = tied[~alone], head[~alone]
        if not len(tied):
            break
        at = order[tied]
        after = np.zeros(len(at), np.uint64)
        inside = at + known < n
        after[inside] = rank[at[inside] + known] + np.uint64(1)
        key = head.astype(np.uint64) << np.uint64(32) | after
        way = np.argsort(key)
        order[tied], ranked = at[way], key[way]
        new = np.ones(len(tied), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        known *= 2
    return order, text[order - 1]


def separated(order: np.ndarray, bwt: np.ndarray, text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """True at each row whose suffix shares less than ``length`` bytes with the row before.

    Level l separates the intervals of the l-byte strings. Extending all intervals of a
    level backward by their transform's symbols gives the next: within the block of a
    symbol, neighbours come from rows of the level before and part where those are parted.
    """
    n = len(text)
    source = np.argsort(bwt, kind="stable")  # the row that a backward extension came from
    parted = np.ones(n, bool)
    first = text[order]
    parted[1:] = first[1:] != first[:-1]
    open_rows = np.flatnonzero(~parted)
    here, before, done = source[open_rows], source[open_rows - 1], 0
    for _ in range(1, length):
        interval = np.cumsum(parted, dtype=np.int32)
        split = np.take(interval, here, mode="clip") != np.take(interval, before, mode="clip")
        many = np.count_nonzero(split)
        if many == done:  # rows that are parted already stay in the list for a while
            break
        parted[open_rows[split]] = True
        done = many
        if done * 8 > len(split):
            stay = ~split
            open_rows, here, before, done = open_rows[stay], here[stay], before[stay], 0
    return parted


def repeats_of_block(pieces: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Of the windows of all pieces, in order: which repeat an earlier one."""
    size = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    order, bwt = transform(text)
    group = np.cumsum(separated(order, bwt, text)) - 1
    nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(start, windows) + nth  # text position of each window
    row_group = np.empty(len(text), np.int64)
    row_group[order] = group
    own = row_group[at]
    least = np.full(int(group[-1]) + 1, len(text))
    np.minimum.at(least, own, at)
    return least[own] != at


def _ordered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(dk, id, body): dk orders the documents. It is the id itself unless ids are missing or shared."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    shared = source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null")
    if shared.isEmpty():
        return source.withColumn("dk", F.col("id").cast("long"))
    return released(number_rows(source, ["id", "body"], out="dk"), "ordered-texts")


def _anchors(texts: DataFrame) -> DataFrame:
    def run(batches):
        pieces = Pieces()
        for batch in batches:
            for _, data, offsets in sliced(batch, "body", SLICE):
                yield pa.RecordBatch.from_arrays([pa.array(pieces.anchors(data, offsets).view(np.int64))], ["anchor"])

    return texts.select("body").mapInArrow(tidy(run), "anchor long")


def _pieces(texts: DataFrame) -> DataFrame:
    """(anchor, h, dk, place): place packs start, windows and whether the document holds the piece before."""

    def run(batches):
        pieces = Pieces()
        for batch in batches:
            for rows, data, offsets in sliced(batch, "body", SLICE):
                doc, start, windows, anchor = pieces.cut(data, offsets)
                h = pieces.hashes(data, start + offsets[doc], windows)
                again = np.ones(len(doc), bool)
                again[np.unique(mix64(h + mix64(anchor + mix64(doc.astype(np.uint64)))), return_index=True)[1]] = False
                place = start << _N_BITS | windows << 1 | again
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(h.view(np.int64)), rows.column(0).take(pa.array(doc)), pa.array(place)],
                                                 ["anchor", "h", "dk", "place"])

    return texts.select("dk", "body").mapInArrow(tidy(run), "anchor long, h long, dk long, place long")


def _batches(columns: dict) -> list[pa.RecordBatch]:
    return pa.table(columns).combine_chunks().to_batches()


def _cut_out(texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Bytes of the first pieces; of those with a hot anchor, a row per window with its hash instead.

    (key, key2, dk, start, windows, again, piece)
    """
    per_doc = firsts.groupBy("dk").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("place").alias("places"), F.collect_list("hot").alias("hots"))
    joined = texts.join(per_doc, "dk").select("dk", "anchors", "places", "hots", "body")

    def run(batches):
        whole = Pieces()
        for batch in batches:
            for rows, data, offsets in sliced(batch, "body", SLICE):
                count = np.diff(rows.column("anchors").offsets.to_numpy())
                anchor, place, hot = (rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("anchors", "places", "hots"))
                doc = np.repeat(np.arange(len(count)), count)
                start, windows = place >> _N_BITS, (place & (1 << _N_BITS) - 1) >> 1
                dk = rows.column("dk").to_numpy()[doc]
                at, cold, raw = start + offsets[doc], np.flatnonzero(~hot), data.tobytes()
                bodies = [raw[a : a + n + LENGTH - 1] for a, n in zip(at[cold].tolist(), windows[cold].tolist(), strict=True)]
                yield from _batches({
                    "key": anchor[cold], "key2": np.zeros(len(cold), np.int64), "dk": dk[cold], "start": start[cold], "windows": windows[cold],
                    "again": np.zeros(len(cold), bool), "piece": pa.array(bodies, pa.binary())})
                warm = np.flatnonzero(hot)
                n = windows[warm]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                each = np.repeat(warm, n)
                first = at[each] + nth
                h1, h2 = (w.hashes(data, first, first + LENGTH) for w in (whole.gram, whole.whole))
                again = np.ones(len(each), bool)
                order = np.argsort(first, kind="stable")
                again[order[np.unique(mix64(h1 + mix64(h2 + mix64(doc[each].astype(np.uint64))))[order], return_index=True)[1]]] = False
                yield from _batches({
                    "key": h1.view(np.int64), "key2": h2.view(np.int64), "dk": dk[each], "start": start[each] + nth, "windows": np.ones(len(each), np.int64),
                    "again": again, "piece": pa.nulls(len(each), pa.binary())})

    return joined.mapInArrow(tidy(run), "key long, key2 long, dk long, start long, windows long, again boolean, piece binary")


def _block_repeats(pieces: DataFrame) -> DataFrame:
    """(dk, start, windows) of repeated windows, from blocks of whole anchors."""

    def solve(held):
        table = pa.Table.from_batches(held).sort_by([("dk", "ascending"), ("start", "ascending")])
        dk, start, windows = (table.column(c).to_numpy() for c in ("dk", "start", "windows"))
        hit = np.flatnonzero(repeats_of_block(table.column("piece").to_pylist(), windows))
        first = np.cumsum(windows) - windows
        piece = np.searchsorted(first, hit, "right") - 1
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (piece[1:] != piece[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(hit)))
        p = piece[head]
        return pa.RecordBatch.from_arrays([pa.array(dk[p]), pa.array(start[p] + hit[head] - first[p]), pa.array(size)], ["dk", "start", "windows"])

    def run(batches):
        held, filled, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            total = np.cumsum(batch.column("windows").to_numpy() + LENGTH)
            a = 0
            starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for b, c in zip(starts[:-1], starts[1:], strict=True):
                more = int(total[c - 1] - (total[b - 1] if b else 0))
                if filled and filled + more > BLOCK_BYTES and key[b] != (key[b - 1] if b else last):
                    if b > a:
                        held.append(batch.slice(a, b - a))
                    yield solve(held)
                    held, filled, a = [], 0, b
                filled += more
            held.append(batch.slice(a))
            last = key[-1]
        if held:
            yield solve(held)

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "dk long, start long, windows long")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(dk, spans): starts and window counts of repeated windows, packed as ``start << 12 | windows``."""
    twice = released(_anchors(texts).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    found = released(_pieces(texts).join(twice, "anchor", "left_semi"), "pieces")
    again = F.col("place").bitwiseAND(F.lit(1)) == 1
    windows = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << _N_BITS) - 1)), 1)
    start = F.shiftright("place", _N_BITS)
    least = released(found.groupBy("anchor", "h").agg(F.min("dk").alias("least")), "first-pieces")
    judged = released(found.join(least, ["anchor", "h"]).withColumn("first", (F.col("dk") == F.col("least")) & ~again).drop("least", "h"), "judged-pieces")
    later = judged.filter(~F.col("first")).select("dk", start.alias("start"), windows.alias("windows"))
    firsts = judged.filter("first").select("anchor", "dk", "place")
    hot = firsts.groupBy("anchor").agg(F.sum(windows + F.lit(LENGTH)).alias("bytes")).filter(F.col("bytes") > ANCHOR_BYTES)
    hot = released(few(hot.select("anchor", F.lit(True).alias("is_hot"))), "hot-anchors")
    marked = firsts.join(hot, "anchor", "left").select("anchor", "dk", "place", F.coalesce("is_hot", F.lit(False)).alias("hot"))
    cut = released(_cut_out(texts, marked), "cut-pieces")
    in_blocks = _block_repeats(cut.filter("piece is not null").select("key", "dk", "start", "windows", "piece"))
    opened = cut.filter("piece is null").select("key", "key2", "dk", "start", "windows", "again")
    opened_least = opened.groupBy("key", "key2").agg(F.min("dk").alias("least"))
    in_windows = opened.join(opened_least, ["key", "key2"]).filter("again or dk <> least").select("dk", "start", "windows")
    spans = later.unionByName(in_blocks).unionByName(in_windows)
    packed = F.shiftleft("start", _N_BITS).bitwiseOR(F.col("windows"))
    return released(spans.groupBy("dk").agg(F.collect_list(packed).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes as ``kept``)."""
    small_batches(docs.sparkSession)
    texts = _ordered(docs, id_col, text)
    spans = repeated_spans(texts)
    kind = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(spans, "dk", "left")

    def make():
        def fn(rows, data, offsets):
            packed = rows.column(1)
            raw, made = data.tobytes(), {"n_bytes": np.diff(offsets), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for i in range(rows.num_rows):
                body, own = raw[offsets[i] : offsets[i + 1]], packed[i]
                gone = np.zeros(len(body) + 1, np.int64)
                if own.is_valid and len(own):
                    span = own.values.to_numpy()
                    np.add.at(gone, span >> _N_BITS, 1)
                    np.add.at(gone, (span >> _N_BITS) + (span & (1 << _N_BITS) - 1) + LENGTH - 1, -1)
                    away = np.cumsum(gone[:-1]) > 0
                    kept = np.frombuffer(body, np.uint8)[~away].tobytes()
                    made["n_spans"].append(int(away[0]) + int((away[1:] & ~away[:-1]).sum()))
                else:
                    kept = body
                    made["n_spans"].append(0)
                made["n_removed"].append(len(body) - len(kept))
                made["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                made["kept"].append(kept if with_text else None)
            return made

        return fn

    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = add_columns(joined, make, fields, "body", ["id", "spans"]).drop("spans")
    return out.select(F.col("id").cast(kind).alias(id_col), *out.columns[1:])
