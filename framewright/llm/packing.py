"""Packing: each window of tokens is filled with lexical neighbours of its seed document.

Documents are laid in an order of content: a tree of at most ``LEAVES`` leaves splits the
space of their BM25 vectors along its widest direction, and inside a leaf they go by
their place along that direction, so that neighbours stand together. Spark ranges and sorts
them in this order, and a task cuts its range into shards of about ``SHARD_BYTES`` of
text. A shard holds a BM25 inverted index of its documents over token ids, with the
document frequencies and mean length of all documents. A seed starts a window; its best
unused neighbours follow until the window is full. The document that reaches the end
is cut there, and its rest seeds the next window, so that only a task's last sequence
is padded.

The tree is fitted on a bounded sample (``PLACING`` documents a leaf, drawn by hash);
every document is placed by it. Texts are tokenised once, the sample twice. The
tokens are written once, with the places and a row of document frequencies per task.

Defined cases: a null or empty text is the end id alone; rows that share an id are
packed each; ties go to the smaller id; a document longer than a window fills whole
windows; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .words import add_columns, mix64, small_batches, tidy

WINDOW, END_ID, SHARD_BYTES = 2048, 1, 6 << 20
#: Shards of a task; leaves of the tree and sampled documents a leaf that place its splits; coordinates of a document's vector.
TASK_SHARDS, LEAVES, PLACING, DIMS = 4, 2048, 40, 64
K1, B = 1.2, 0.75
#: Terms of more than this share of a shard's documents are scored by a dense matrix, the rest by posting lists.
DENSE = 1 / 16
#: Fixed value: how byte-level vocabularies of this kind split a text before merging, written without backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Encoder:
    """Token ids of a byte-level BPE file, as the tokenizers library gives them with ``add_special_tokens=False``.

    Strings of the file's added tokens give their own ids; the text between them goes
    through ``tiktoken``, which is several times faster.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Visible stand-ins for bytes: printable Latin-1 stands for itself, the rest follow from U+0100 on.
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
        added = spec.get("added_tokens", ())
        if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path}: added tokens that match more than their own string are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in self.added}
        self.n_ids = max([*ranks.values(), *self.added.values()]) + 1
        self.kind = "<u2" if self.n_ids <= 1 << 16 else "<u4"
        self.encode = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def __call__(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):
            return self.encode(text)
        out = []
        for part in self.parts.split(text):
            out += [self.added[part]] if part in self.added else self.encode(part)
        return out


def load_tokenizer(path: str) -> Encoder:
    """The encoder of ``path``, kept by the process."""
    kept = sys.__dict__.setdefault("_framewright_models", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Corpus:
    """Document frequencies by token id, number and mean length of the documents that BM25 weighs by."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float):
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = mean

    def weights(self, terms, tf, size):
        return self.idf[terms] * tf * np.float32(K1 + 1) / (tf + np.float32(K1) * (np.float32(1 - B) + np.float32(B / self.mean) * size))


class Tree:
    """Splits of vectors into leaves of about equal bytes, each along its widest direction; leaves are numbered in order."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, leaves: int):
        self.direction, self.bound, self.below, self.along = [], [], [], []
        todo = [(np.arange(len(vectors)), leaves, None)]
        while todo:
            rows, many, slot = todo.pop()
            at, direction = None, np.eye(1, vectors.shape[1], dtype=np.float32)[0]
            if len(rows) > 1:
                x = vectors[rows].astype(np.float64)
                x -= x.mean(axis=0)
                direction = np.linalg.eigh(x.T @ x)[1][:, -1].astype(np.float32)
            if many > 1 and len(rows) > 1:
                along = (vectors[rows] * direction).sum(axis=1)
                order = np.argsort(along, kind="stable")
                part = np.cumsum(sizes[rows][order])
                share = (part / max(1, part[-1]))[:-1]
                gap = np.diff(along[order])
                # The widest gap near the middle: copies of a text are not parted.
                middle = np.abs(share - 0.5) <= 0.2
                cut = int(np.argmax(np.where(middle, gap, 0))) if gap[middle].any() else int(np.argmax(gap))
                bound = along[order[cut]]
                if (along > bound).any():
                    at, left = len(self.bound), int(np.clip(round(many * share[cut]), 1, many - 1))
                    self.direction.append(direction)
                    self.bound.append(bound)
                    self.below.append([0, 0])
                    todo += [(rows[along > bound], many - left, (at, 1)), (rows[along <= bound], left, (at, 0))]
            if at is None:
                at = ~len(self.along)
                self.along.append(direction)
            if slot is not None:
                self.below[slot[0]][slot[1]] = at
        self.direction, self.bound = np.array(self.direction, np.float32).reshape(-1, vectors.shape[1]), np.array(self.bound, np.float32)
        self.below, self.along = np.array(self.below, np.int64).reshape(-1, 2), np.array(self.along, np.float32)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, place along the leaf's widest direction) of every row."""
        at = np.full(len(vectors), 0 if len(self.bound) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            now = at[inner]
            at[inner] = self.below[now, ((vectors[inner] * self.direction[now]).sum(axis=1) > self.bound[now]).astype(int)]
        return ~at, (vectors * self.along[~at]).sum(axis=1)


def vectors(counts: list[tuple[np.ndarray, np.ndarray]], sizes: np.ndarray, corpus: Corpus, signs: np.ndarray) -> np.ndarray:
    """BM25 vectors of length one, projected to DIMS coordinates; zero without tokens."""
    out = np.zeros((len(counts), DIMS), np.float32)
    for i, (terms, tf) in enumerate(counts):
        if len(terms):
            w = corpus.weights(terms, tf.astype(np.float32), np.float32(sizes[i]))
            out[i] = w @ signs[terms] / max(1e-9, float(w @ w) ** 0.5)
    return out


def random_signs(n_terms: int) -> np.ndarray:
    out = np.empty(n_terms * DIMS, np.float32)
    for first in range(0, len(out), 1 << 17):  # in pieces, so that no task holds several tables of this size
        part = np.arange(first, min(len(out), first + (1 << 17)), dtype=np.uint64)
        out[first : first + len(part)] = (mix64(part) >> np.uint64(63)).astype(np.float32) * 2 - 1
    return out.reshape(-1, DIMS)


class Index:
    """BM25 over the token ids of one shard's documents, weighed by ``corpus`` (these documents by default)."""

    def __init__(self, ids: list[np.ndarray], corpus: Corpus | None = None):
        found = [np.unique(x[:-1], return_counts=True) for x in ids]
        sizes = np.array([len(x) for x in ids], np.float32)
        self.own = [t.astype(np.int64) for t, _ in found]
        terms = np.concatenate(self.own)
        tf = np.concatenate([c for _, c in found]).astype(np.float32)
        doc = np.repeat(np.arange(len(ids)), [len(t) for t in self.own])
        df = np.bincount(terms, minlength=1)
        corpus = corpus or Corpus(df, len(ids), float(sizes.mean()))
        weight = corpus.weights(terms, tf, sizes[doc]).astype(np.float32)
        # What most documents share is a matrix, the rest posting lists.
        self.column = np.full(len(df), -1)
        common = np.flatnonzero(df > max(8, DENSE * len(ids)))
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((len(ids), len(common)), np.float32)
        at = self.column[terms]
        self.dense[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        rare = np.flatnonzero(at < 0)
        order = rare[np.argsort(terms[rare].astype(np.uint32), kind="stable")]
        self.doc, self.weight = doc[order], weight[order].astype(float)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(terms[rare], minlength=len(df)))])
        self.used = np.zeros(len(ids), bool)
        self.next = 0

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the terms of ``seed``."""
        own = self.own[seed]
        at = self.column[own]
        query = np.zeros(self.dense.shape[1], np.float32)
        query[at[at >= 0]] = 1
        own = own[at < 0]
        start = self.first[own]
        many = self.first[own + 1] - start
        at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=len(self.used)) + self.dense @ query

    def neighbours(self, seed: int):
        """Unused documents, the best neighbour of ``seed`` first; those that share no term last."""
        scores = self.scores(seed)
        scores[self.used] = 0
        while True:
            best = int(np.argmax(scores))
            if scores[best] <= 0:
                break
            scores[best] = 0
            yield best
        yield from iter(self.any, None)

    def any(self) -> int | None:
        while self.next < len(self.used) and self.used[self.next]:
            self.next += 1
        return self.next if self.next < len(self.used) else None


def fill(ids: list[np.ndarray], window: int, corpus: Corpus | None = None, sequence: int = 0, offset: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, from a place in a sequence on."""
    index, out = Index(ids, corpus), []

    def lay(doc: int) -> bool:
        """Lay a whole document; true if it crossed (or reached) the end of a window."""
        nonlocal sequence, offset
        start, crossed = 0, False
        while start < len(ids[doc]):
            n = min(window - offset, len(ids[doc]) - start)
            out.append((doc, start, n, sequence, offset))
            start, offset = start + n, offset + n
            if offset == window:
                sequence, offset, crossed = sequence + 1, 0, True
        return crossed

    seed = index.any()
    while seed is not None:
        if not index.used[seed]:
            index.used[seed] = True
            lay(seed)
        following = None
        for doc in index.neighbours(seed):
            index.used[doc] = True
            if lay(doc):
                following = doc
                break
        seed = following
    return out


def encoded(source: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(id, ids, n_bytes) of (id, body); ids packed in 2 or 4 bytes each."""

    def make():
        encoder = load_tokenizer(tokenizer)

        def fn(rows, data, offsets):
            raw = data.tobytes()
            ids = [np.array([*encoder(raw[a:b].decode("utf-8", "replace")), end_id], encoder.kind).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return {"ids": ids, "n_bytes": np.diff(offsets) + 1}

        return fn

    return add_columns(source, make, "ids binary, n_bytes long", "body", ["id"])


def total_frequencies(rows: DataFrame, counted, n_terms: int) -> np.ndarray:
    """Document frequencies of all terms: ``counted(value) -> (terms, numbers)`` of the binary column, added up. The result is as long as the vocabulary."""

    def count(batches):
        import pyarrow as pa

        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                terms, many = counted(value)
                df[terms] += many
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], ["term", "n"])

    found = rows.mapInArrow(tidy(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return df


def fit_tree(source: DataFrame, tokenizer: str, end_id: int, kind: str, n_terms: int, leaves: int, n_docs: int) -> tuple[Tree, Corpus]:
    """The tree of a sample, and the statistics that its vectors are weighed by."""
    if leaves < 2:
        return Tree(np.zeros((0, DIMS), np.float32), np.zeros(0), 1), Corpus(np.zeros(n_terms, np.int64), 0, 1.0)
    share = int(min(1.0, PLACING * leaves / n_docs) * (1 << 20))
    chosen = source.filter(F.pmod(F.xxhash64("id", "body"), F.lit(1 << 20)) < share)
    sample = materialize(encoded(chosen, tokenizer, end_id), "placing")
    width = int(kind[2])
    n, length = (x or 0 for x in sample.agg(F.count(F.lit(1)), F.sum(F.length("ids"))).first())
    df = total_frequencies(sample.select("ids"), lambda x: (np.unique(np.frombuffer(x, kind)[:-1]), 1), n_terms)
    corpus = Corpus(df, n, max(1.0, length / width / max(1, n)))

    def project(batches):
        import pyarrow as pa

        signs = random_signs(n_terms)
        for batch in batches:
            ids = [np.frombuffer(x, kind) for x in batch.column(0).to_pylist()]
            at = vectors([np.unique(x[:-1], return_counts=True) for x in ids], np.array([len(x) for x in ids]), corpus, signs)
            yield pa.RecordBatch.from_arrays([pa.array([v.astype(np.float16).tobytes() for v in at], pa.binary()), batch.column(1)], ["vector", "n_bytes"])

    # LEAVES * PLACING rows of 128 bytes in the mean at most.
    got = sample.select("ids", "n_bytes").mapInArrow(tidy(project), "vector binary, n_bytes long").toArrow()
    at = np.frombuffer(b"".join(got.column("vector").to_pylist()), np.float16).reshape(-1, DIMS).astype(np.float32)
    # The rows come in any order; the tree does not depend on it.
    order = np.lexsort([got.column("n_bytes").to_numpy(), *at.T])
    return Tree(at[order], got.column("n_bytes").to_numpy()[order].astype(float), leaves), corpus


def place_tokens(source: DataFrame, tokenizer: str, end_id: int, kind: str, n_terms: int, tree: Tree, weighing: Corpus) -> DataFrame:
    """(id, ids, n_bytes, leaf, along, counts): every document with its place, and per task one row with only its counts."""
    tokens = encoded(source, tokenizer, end_id)
    names = ["id", "ids", "n_bytes", "leaf", "along", "counts"]
    sent = source.sparkSession.sparkContext.broadcast((tree, weighing))

    def run(batches):
        import pyarrow as pa

        (tree, weighing), signs, df, id_type = sent.value, None, np.zeros(n_terms, np.int64), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            ids = [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()]
            counts = [np.unique(x[:-1], return_counts=True) for x in ids]
            df += np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for t, _ in counts]]), minlength=n_terms)
            at = np.zeros((len(ids), DIMS), np.float32)
            if len(tree.bound):
                signs = random_signs(n_terms) if signs is None else signs
                at = vectors(counts, np.array([len(x) for x in ids]), weighing, signs)
            leaf, along = tree.place(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32()), pa.array(along, pa.float32()), pa.nulls(len(ids), pa.binary())], names)
        terms = np.flatnonzero(df)
        if len(terms):
            packed = np.concatenate([terms, df[terms]]).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float32()), pa.array([packed], pa.binary())], names)

    fields = [*tokens.schema.fields, *T.StructType.fromDDL("leaf int, along float, counts binary").fields]
    return materialize(tokens.mapInArrow(tidy(run), T.StructType(fields)), "tokens")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text: str = "text",
         shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """Pieces: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the token ids)."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    encoder = load_tokenizer(tokenizer)
    kind, n_terms = encoder.kind, max(encoder.n_ids, end_id + 1)
    n_docs, size = (x or 0 for x in source.agg(F.count(F.lit(1)), F.sum(F.octet_length("body") + 1)).first())
    n_shards = max(1, -(-size // shard_bytes))
    tokens = place_tokens(source, tokenizer, end_id, kind, n_terms, *fit_tree(source, tokenizer, end_id, kind, n_terms, min(n_shards, LEAVES), n_docs))

    def counted(packed):
        terms, many = np.frombuffer(packed, "<u4").reshape(2, -1)
        return terms, many

    df = total_frequencies(tokens.filter("counts is not null").select("counts"), counted, n_terms)
    rows = tokens.filter("counts is null").select("id", "ids", "n_bytes", "leaf", "along")
    length = rows.agg(F.sum(F.length("ids"))).first()[0] or 0
    corpus = Corpus(df, n_docs, max(1.0, length / int(kind[2]) / max(1, n_docs)))
    # Copies share a place; the last key parts them, so a range of them can be cut.
    tasks = max(1, -(-n_shards // TASK_SHARDS))
    order = ["leaf", "along", F.xxhash64("id", "ids")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(F.spark_partition_id().cast("long").alias("task"), "id", "ids", "n_bytes")

    def run(batches):
        import pyarrow as pa

        held, size, sequence, offset = [], 0, 0, 0

        def packed():
            nonlocal sequence, offset
            rows = pa.Table.from_batches(held).sort_by([("id", "ascending"), ("ids", "ascending")])
            ids = [np.frombuffer(x, kind) for x in rows.column("ids").to_pylist()]
            pieces = np.array(fill(ids, window, corpus, sequence, offset), np.int64).reshape(-1, 5)
            cuts = [ids[d][s : s + n] for d, s, n, _, _ in pieces.tolist()]
            sequence, offset = divmod(int(pieces[-1, 3] * window + pieces[-1, 4] + pieces[-1, 2]), window)
            made = {
                "id": rows.column("id").take(pa.array(pieces[:, 0])), "start": pieces[:, 1], "length": pieces[:, 2],
                "ids_crc32": np.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cuts], np.int64),
                "doc_tokens": np.array([len(x) for x in ids], np.int64)[pieces[:, 0]],
                "sequence_id": (rows.column("task")[0].as_py() << 32) + pieces[:, 3], "offset": pieces[:, 4],
            }
            if with_ids:
                made["ids"] = pa.array([c.astype(np.int32) for c in cuts], pa.list_(pa.int32()))
            return pa.table(made).combine_chunks().to_batches()

        for batch in batches:
            sizes = np.cumsum(batch.column("n_bytes").to_numpy())
            first = 0
            while first < batch.num_rows:
                before = sizes[first - 1] if first else 0
                last = min(batch.num_rows, int(np.searchsorted(sizes, before + shard_bytes - size)) + 1)
                held.append(batch.slice(first, last - first))
                size, first = size + int(sizes[last - 1] - before), last
                if size >= shard_bytes:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    fields = [T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return dealt.mapInArrow(tidy(run), T.StructType(fields)).withColumnRenamed("id", id_col)
