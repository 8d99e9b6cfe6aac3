"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

Words and runs of signs are hashed together with their shapes (upper, title, lower,
digits, sign, "same as before"), alone and as n-grams of neighbours, into ``2**BITS``
weights; a text's features are its mean over them, so a score is one sparse dot product.

Training takes a bounded sample of the labelled rows (``max_train``, the documented
bound), dealt to ``shards`` tasks that each run the leader updates over their rows;
their weights are averaged. Scoring covers every whole text.

Defined cases: a null or empty text has no words and its score is that of the bias;
rows without a label or id don't train; several labels of one id all train; without
any label every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, add_columns, mix64, sliced

BITS, SCALE = 18, 8.0
#: Rows used for training (expected number), and the tasks that share them.
MAX_TRAIN, SHARDS, EPOCHS = 16_000, 4, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4


class Features:
    """Hashed n-gram features of the texts of a slice, in text order."""

    def __init__(self):
        self.words = Words("solid")
        solid, letters = self.words.word, Words("alnum").word
        self.kind = np.zeros(256, np.int8)  # 0 space, 1 sign, 2 letter or digit
        self.kind[solid] = 1
        self.kind[letters] = 2
        b = np.arange(256)
        self.upper = (b >= 65) & (b <= 90)
        self.digit = (b >= 48) & (b <= 57)

    def tokens(self, data: np.ndarray, offsets: np.ndarray):
        """(document, hash, shape) of each run of word bytes and each run of signs."""
        kind = np.zeros(len(data) + 2, np.int8)
        kind[1:-1] = self.kind[data]
        change = kind[1:] != kind[:-1]
        change[offsets[1:-1]] = True
        edge = np.flatnonzero(change)
        start, end = edge[:-1], edge[1:]
        solid = kind[start + 1] > 0
        start, end = start[solid], end[solid]
        doc = np.searchsorted(offsets, start, "right") - 1
        word = self.words.hashes(data, start, end)
        sign = kind[start + 1] == 1
        ups = np.concatenate([[0], np.cumsum(self.upper[data], dtype=np.int64)])
        digits = np.concatenate([[0], np.cumsum(self.digit[data], dtype=np.int64)])
        n = end - start
        up, digit = ups[end] - ups[start], digits[end] - digits[start]
        shape = np.where(digit * 2 > n, 4, np.where((up * 2 > n) & (n > 1), 1, np.where(self.upper[data[start]], 2, 3))).astype(np.uint64)
        shape = np.where(sign, word, shape)
        same = np.zeros(len(word), bool)
        same[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
        shape = shape + np.where(same, np.uint64(1000), np.uint64(0))
        return doc, word, shape

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of every n-gram: words of 1 and 2, shapes of 1 to 3."""
        doc, word, shape = self.tokens(data, offsets)
        docs, out = [], []
        for values, orders, salt in ((word, (1, 2), 11), (shape, (1, 2, 3), 77)):
            total = mix64(values + np.uint64(salt))
            for k in range(1, max(orders) + 1):
                if k > 1:
                    total = mix64(total[:-1] * np.uint64(31) + values[k - 1 :])
                inside = doc[k - 1 :] == doc[: len(doc) - k + 1] if len(doc) >= k else np.zeros(0, bool)
                total = total[: len(inside)]
                docs.append(doc[: len(inside)][inside])
                out.append(total[inside] >> np.uint64(64 - BITS))
        return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def leader_updates(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Weights of logistic regression after ``EPOCHS`` rounds of follow-the-regularised-leader."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(EPOCHS):
        for (at, x), y in zip(features, labels, strict=True):
            w = np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text",
          max_train: int = MAX_TRAIN, shards: int = SHARDS) -> np.ndarray:
    """Averaged weights (the bias last). ``trains``: which ids may train, over a column ``id``."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).filter("id is not null and y is not null").filter(trains).distinct()
    bound = F.lit(min(1.0, max_train / max(1, usable.count())) * (1 << 31)).cast("long")
    taken = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 31)) < bound
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    rows = texts.filter(trains).filter(taken).join(F.broadcast(usable.filter(taken)), "id")  # max_train rows of 16 bytes
    # Repeated rows count once; where many rows share an id, rows are drawn once more.
    rows = materialize(rows.withColumn("key", F.xxhash64("id", "y", "body")).dropDuplicates(["key"]), "labelled-sample")
    share = int(min(1.0, max_train / max(1, rows.count())) * (1 << 31))
    rows = rows.filter(F.pmod(F.xxhash64("key", F.lit("row")), F.lit(1 << 31)) < share) if share < 1 << 31 else rows
    dealt = rows.select(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).alias("shard"), "id", "y", "body", "key")

    def fit(key, batches):
        import pyarrow as pa

        rows = pa.Table.from_batches(batches).combine_chunks().sort_by([("id", "ascending"), ("key", "ascending")])
        make, features = Features(), []
        for batch in rows.combine_chunks().to_batches():
            for part, data, offsets in sliced(batch, "body"):
                doc, at = make.grams(data, offsets)
                many = np.bincount(doc, minlength=part.num_rows)
                unique, count = np.unique(doc << (BITS + 1) | at, return_counts=True)
                bounds = np.searchsorted(unique >> (BITS + 1), np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = slice(bounds[i], bounds[i + 1])
                    own_at = np.append(unique[own] & ((1 << BITS) - 1), 1 << BITS).astype(np.int32)
                    features.append((own_at, np.append(count[own] * (SCALE / max(1, many[i])), 1.0).astype(np.float32)))
        w = leader_updates(features, rows.column("y").to_numpy())
        made = pa.table({"n": pa.array([len(features)], pa.int64()), "w": [w.astype("<f4").tobytes()]})
        del rows, features
        pa.default_memory_pool().release_unused()
        return made

    fitted = dealt.groupBy("shard").applyInArrow(_whole(fit), "n long, w binary").collect()
    if not fitted:
        return np.zeros((1 << BITS) + 1, np.float32)
    share = np.array([r["n"] for r in fitted], float)
    return np.average([np.frombuffer(r["w"], "<f4") for r in fitted], axis=0, weights=share).astype(np.float32)


def _whole(fit):
    """``applyInArrow`` function over a group's table; a group is a bounded share of the sample."""

    def run(key, table):
        return fit(key, table.to_batches())

    return run


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """The kept columns and ``out``: the probability (0 to 1) that the label is 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        make_grams, w = Features(), held.value

        def fn(rows, data, offsets):
            doc, at = make_grams.grams(data, offsets)
            n = rows.num_rows
            total = np.bincount(doc, weights=w[at], minlength=n) * SCALE / np.maximum(1, np.bincount(doc, minlength=n))
            return {out: 1 / (1 + np.exp(-np.clip(total + w[-1], -35, 35)))}

        return fn

    return add_columns(docs, make, f"`{out}` double", text, keep)
