"""Line dedup: a sharded minimal perfect hash over repeated lines, probed by the documents.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents
are dropped everywhere but in the largest document id that holds them.

Defined cases: a null or empty text is one empty line; a line repeated inside one
document counts once, and the keeper keeps all of its copies; a document without an
id counts for no key and loses its lines of dropped keys; rows that share an id count
as one document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import add_columns, mix64, sliced, small_batches, tidy

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys of one shard, and bytes of index arrays that one pass over the documents may broadcast.
SHARD_KEYS, PASS_BYTES = 250_000, 64 << 20
_KEY = np.dtype([("h1", "<u8"), ("h2", "<u8")])


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """Sixteen hash bytes of a line's key, None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def hash_lines(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Lines of each text, and (document, line number, hash) of every line that has a key."""
    raw, texts, doc, number, found = data.tobytes(), [], [], [], []
    for i in range(len(offsets) - 1):
        lines = raw[offsets[i] : offsets[i + 1]].split(b"\n")
        texts.append(lines)
        for j, line in enumerate(lines):
            h = key_hash(line, min_chars)
            if h is not None:
                doc.append(i)
                number.append(j)
                found.append(h)
    keys = np.frombuffer(b"".join(found), _KEY)
    return texts, np.array(doc, np.int64), np.array(number, np.int64), keys["h1"].copy(), keys["h2"].copy()


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, a key settles where it is alone."""

    def __init__(self, bits: list[np.ndarray], ranks: list[np.ndarray]):
        self.bits, self.ranks = bits, ranks

    @staticmethod
    def build(keys: np.ndarray) -> PerfectHash:
        bits, ranks, done, level = [], [], 0, 0
        while len(keys):
            size = (len(keys) * 3 // 2 + 64) // 64 * 64
            at = mix64(keys + np.uint64(level)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            packed = np.packbits(alone, bitorder="little").view(np.uint64)
            per_word = np.bitwise_count(packed).astype(np.int64)
            bits.append(packed)
            ranks.append((done + np.cumsum(per_word) - per_word).astype(np.uint32))
            done += int(per_word.sum())
            keys = keys[~alone[at.astype(np.int64)]]
            level += 1
        return PerfectHash(bits, ranks)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no level has its bit."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (packed, rank) in enumerate(zip(self.bits, self.ranks, strict=True)):
            at = mix64(keys[left] + np.uint64(level)) % np.uint64(64 * len(packed))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (packed[word] >> bit) & np.uint64(1) == 1
            below = packed[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (rank[word] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(b) for b in self.bits], "<i8")
        return b"".join([np.int64(len(sizes)).tobytes(), sizes.tobytes(), *(b.tobytes() for b in self.bits), *(r.tobytes() for r in self.ranks)])

    @staticmethod
    def from_bytes(raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes, at = np.frombuffer(raw, "<i8", n, 8), 8 + 8 * n
        bits, ranks = [], []
        for into, kind, width in ((bits, "<u8", 8), (ranks, "<u4", 4)):
            for size in sizes:
                into.append(np.frombuffer(raw, kind, int(size), at))
                at += width * int(size)
        return PerfectHash(bits, ranks)


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text: str) -> DataFrame:
    """(h1, h2, n_docs, keeper) of the keys that at least ``min_docs`` documents hold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, data, offsets in sliced(batch, "body"):
                _, doc, _, h1, h2 = hash_lines(data, offsets, min_chars)
                once = pd.DataFrame({"doc": doc, "h1": h1.view(np.int64), "h2": h2.view(np.int64)}).drop_duplicates()
                ids = rows.column(0).take(pa.array(once["doc"].to_numpy()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(once["h1"].to_numpy()), pa.array(once["h2"].to_numpy())], ["id", "h1", "h2"])

    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("body")).mapInArrow(tidy(run), "id long, h1 long, h2 long")
    return lines.groupBy("h1", "h2").agg(F.countDistinct("id").alias("n_docs"), F.max("id").alias("keeper")).filter(F.col("n_docs") >= min_docs)


def build_index(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One row per shard: the perfect hash and, by slot, fingerprints, counts and keepers."""
    n_shards = max(1, -(-keys.count() // shard_keys))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        h1 = rows["h1"].to_numpy().view(np.uint64)
        hashed = PerfectHash.build(h1)
        order = np.argsort(hashed.slots(h1))
        arrays = [rows[c].to_numpy()[order].astype(k).tobytes() for c, k in (("h2", "<i8"), ("n_docs", "<i8"), ("keeper", "<i8"))]
        return pd.DataFrame([[rows["shard"].iloc[0], hashed.to_bytes(), *arrays]], columns=["shard", "hash", "prints", "n_docs", "keepers"])

    dealt = keys.dropDuplicates(["h1"]).withColumn("shard", F.pmod("h1", F.lit(n_shards)))
    return dealt.groupBy("shard").applyInPandas(build, "shard long, hash binary, prints binary, n_docs binary, keepers binary").withColumn("n_shards", F.lit(n_shards))


def passes(index: DataFrame, limit: int) -> list[list[int]]:
    """Shards that go together in one pass, by the size of their arrays."""
    sizes = index.select("shard", F.expr("length(hash) + 3 * length(prints)").alias("bytes")).orderBy("shard").collect()
    out, filled = [[]], 0
    for row in sizes:
        if out[-1] and filled + row["bytes"] > limit:
            out.append([])
            filled = 0
        out[-1].append(row["shard"])
        filled += row["bytes"]
    return out


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text: str = "text",
                        keep: list[str] | None = None, digest: bool = False, pass_bytes: int = PASS_BYTES, prefix: str = "") -> DataFrame:
    """Documents with their repeated lines dropped.

    Columns: those of ``keep`` (all by default), the shortened ``text`` (its SHA-256
    ``kept_sha256`` if ``digest``), ``n_lines`` and ``n_dropped`` (after ``prefix``). The index covers only
    lines that must go. If it is larger than ``pass_bytes``, several passes over the
    documents probe one group of shards each.
    """
    spark = docs.sparkSession
    small_batches(spark)
    keys = materialize(repeated_lines(docs, min_chars, min_docs, id_col, text), "repeated-lines")
    index = materialize(build_index(keys), "line-index")
    names = list(docs.columns if keep is None else keep)
    names = [id_col, *[c for c in names if c != id_col]]
    groups, out = passes(index, pass_bytes), docs
    for k, shards in enumerate(groups):
        rows = index.filter(F.col("shard").isin(shards)).collect() if shards else []
        parts = spark.sparkContext.broadcast([tuple(r) for r in rows])
        last = k == len(groups) - 1
        fields = f"{prefix}n_lines long, {prefix}n_dropped long, " + (("kept_sha256 string" if digest else f"`{text}` string") if last else f"_dropped_lines{k} binary")
        carried = [id_col, f"_dropped_lines{k - 1}", *names[1:]] if k else names

        def make(parts=parts, last=last, seen=1 if k else None, k=k):
            shards = {r[0]: (PerfectHash.from_bytes(r[1]), np.frombuffer(r[2], "<i8").view(np.uint64), np.frombuffer(r[4], "<i8")) for r in parts.value}
            n_shards = parts.value[0][5] if parts.value else 1

            def fn(rows, data, offsets):
                texts, doc, number, h1, h2 = hash_lines(data, offsets, min_chars)
                gone = np.zeros(len(doc), bool)
                ids = pd.Series(rows.column(0).to_pandas()).astype("Int64")
                own, none = ids.fillna(0).to_numpy(np.int64), ids.isna().to_numpy(bool)
                shard = h1.view(np.int64) % n_shards
                for s in np.unique(shard):
                    if int(s) in shards:
                        hashed, prints, keepers = shards[int(s)]
                        at = np.flatnonzero(shard == s)
                        slot = hashed.slots(h1[at])
                        known = (slot >= 0) & (prints[slot] == h2[at])
                        gone[at] = known & ((keepers[slot] != own[doc[at]]) | none[doc[at]])
                drop = [set() for _ in texts] if seen is None else [set(np.frombuffer(x, "<i4").tolist()) for x in rows.column(seen).to_pylist()]
                for i, j in zip(doc[gone].tolist(), number[gone].tolist(), strict=True):
                    drop[i].add(j)
                made = {f"{prefix}n_lines": [len(x) for x in texts], f"{prefix}n_dropped": [len(x) for x in drop]}
                if not last:
                    return made | {f"_dropped_lines{k}": [np.array(sorted(x), "<i4").tobytes() for x in drop]}
                kept = [b"\n".join([y for j, y in enumerate(x) if j not in d] if d else x) for x, d in zip(texts, drop, strict=True)]
                if digest:
                    return made | {"kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept]}
                return made | {text: [x.decode("utf-8", "replace") for x in kept]}

            return fn

        out = add_columns(out, make, fields, text, carried + ([text] if not last and text not in carried else []))
        if not last:
            out = materialize(out, "line-pass")
    wanted = list(docs.columns if keep is None else keep)
    made = [f"{prefix}n_lines", f"{prefix}n_dropped", *(["kept_sha256"] if digest else [])]
    return out.select(*[c for c in wanted if c not in made], *([] if digest or text in wanted else [text]), *made)
