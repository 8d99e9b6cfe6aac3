"""Language identification by error-correcting output codes.

Every language gets a codeword; each bit of it is one binary classifier over hashed
byte n-grams (one to three bytes of the lower-cased letters, word edges included). The
bits' outputs are decoded by weighted loss: the codeword with the least sum of
``weight x log(1 + exp(-sign x margin))`` wins, a bit's weight being its training
accuracy above chance. A small gap to the second codeword flags an ambiguous text.

Training takes a bounded sample of the labelled rows (``max_train``), dealt to
``shards`` tasks, and averages their classifiers. Prediction covers every whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows
without a language or id don't train; with one language it is always predicted; without
any, every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import add_columns, mix64, sliced

BITS, ORDERS, SCALE = 16, (1, 2, 3), 20.0
#: Rows used for training (expected number), the tasks that share them, rounds over them.
MAX_TRAIN, SHARDS, EPOCHS, RATE = 8_000, 4, 3, 0.5
#: A gap between the two best scores under this is ambiguous.
AMBIGUOUS = 0.2


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1, one for each of ``n`` languages, far apart and never constant by bit.

    Up to 7 languages get the exhaustive code (every split of the languages once);
    more get hashed splits, 15 bits for each doubling of their number.
    """
    if n <= 7:
        splits = np.arange(1, max(2, 1 << (n - 1)))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1)
    bits = 15 * int(np.ceil(np.log2(n)))
    grid = mix64(np.arange(n * bits, dtype=np.uint64) + np.uint64(seed * 1_000_003)).reshape(n, bits)
    rank = np.argsort(np.argsort(grid, axis=0), axis=0)
    return np.where(rank < n // 2, 1, -1)  # every bit halves the languages


class Grams:
    """Hashed n-grams of the letters of a slice; other bytes become one edge mark."""

    def __init__(self):
        b = np.arange(256)
        letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
        self.code = np.where(letter, np.where((b >= 65) & (b <= 90), b + 32, b), 32).astype(np.uint64)

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of every n-gram that is not only edges."""
        value = self.code[data]
        length = np.diff(offsets)
        doc = np.repeat(np.arange(len(length)), length)
        # Latin capitals beyond ASCII: C3 80..9E are the capitals of C3 A0..BE.
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        value = np.where(lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), value + np.uint64(32), value)
        keep = np.ones(len(data), bool)
        keep[1:] = (value[1:] != 32) | (value[:-1] != 32)  # one mark between words
        value, doc = value[keep], doc[keep]
        docs, out = [], []
        total, letters = np.zeros(len(value), np.uint64), value != 32
        any_letter = np.zeros(len(value), bool)
        for k in range(1, max(ORDERS) + 1):
            n = len(value) - k + 1
            if n <= 0:
                break
            total = total[:n] * np.uint64(257) + value[k - 1 :]
            any_letter = any_letter[:n] | letters[k - 1 :]
            if k in ORDERS:
                inside = (doc[k - 1 :] == doc[:n]) & any_letter
                docs.append(doc[:n][inside])
                out.append((mix64(total[inside] + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(docs), np.concatenate(out)


def fit_bits(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, hits): one logistic classifier per bit, all trained together; right signs in the last round."""
    w = np.zeros(((1 << BITS) + 1, signs.shape[1]), np.float32)
    hits = np.zeros(signs.shape[1])
    for epoch in range(EPOCHS):
        hits[:] = 0
        for (at, x), sign in zip(rows, signs, strict=True):
            margin = x @ w[at]
            hits += margin * sign > 0
            slope = sign / (1 + np.exp(np.clip(margin * sign, -30, 30))) * (RATE / (1 + epoch))
            w[at] += np.outer(x, slope).astype(np.float32)
    return w, hits


def train(docs: DataFrame, trains: Column, label: str = "lang", id_col: str = "doc_id", text: str = "text",
          max_train: int = MAX_TRAIN, shards: int = SHARDS) -> dict:
    """The languages, their codewords, bit weights and classifiers. ``trains``: over a column ``id``."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("y"), F.col(text).cast("string").alias("body")).filter(
        "id is not null and y is not null").filter(trains)
    # A repeated row counts once, for the bound and in the sample; rows of one id are drawn each for itself.
    labelled = labelled.withColumn("key", F.xxhash64("id", "body"))
    found = labelled.groupBy("y").agg(F.countDistinct("key").alias("n")).orderBy("y").collect()  # one row per language
    languages = [r["y"] for r in found]
    if not languages:
        return {"languages": []}
    code = codewords(len(languages))
    # Each language may fill an equal share of the bound, so that rare ones are learnt too.
    share = {r["y"]: min(1.0, max_train / len(languages) / r["n"]) for r in found}
    bound = F.element_at(F.create_map(*[F.lit(v) for y, s in share.items() for v in (y, int(s * (1 << 31)))]), F.col("y"))
    taken = labelled.filter(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 31)) < bound).dropDuplicates(["key", "y"])
    dealt = taken.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)))

    def fit(table):
        import pyarrow as pa

        table = table.select(["id", "y", "body", "key"]).sort_by([("id", "ascending"), ("key", "ascending"), ("y", "ascending")])
        grams, rows = Grams(), []
        for batch in table.combine_chunks().to_batches():
            for part, data, offsets in sliced(batch, "body"):
                doc, at = grams.of(data, offsets)
                unique, count = np.unique(doc << BITS | at, return_counts=True)
                edge = np.searchsorted(unique >> BITS, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    own = slice(edge[i], edge[i + 1])
                    x = count[own].astype(np.float32)
                    rows.append((np.append(unique[own] & ((1 << BITS) - 1), 1 << BITS), np.append(x * (SCALE / max(1.0, float(x.sum()))), 1).astype(np.float32)))
        signs = code[[languages.index(y) for y in table.column("y").to_pylist()]]
        order = np.argsort(mix64(np.arange(len(rows), dtype=np.uint64)))  # languages mixed
        w, hits = fit_bits([rows[i] for i in order], signs[order])
        return pa.table({"n": pa.array([len(rows)], pa.int64()), "w": [w.tobytes()], "hits": [hits.tobytes()]})

    fitted = dealt.groupBy("shard").applyInArrow(fit, "n long, w binary, hits binary").collect()
    n = np.array([r["n"] for r in fitted], float)
    w = np.average([np.frombuffer(r["w"], np.float32).reshape(-1, code.shape[1]) for r in fitted], axis=0, weights=n).astype(np.float32)
    accuracy = sum(np.frombuffer(r["hits"]) for r in fitted) / n.sum()
    return {"languages": languages, "code": code, "weights": w, "bit_weight": np.maximum(0.01, 2 * accuracy - 1)}


def predict(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and lang_pred, score (0 to 1), ambiguous."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        import pyarrow as pa
        import pyarrow.compute as pc

        grams, m = Grams(), held.value
        names = np.array([*m["languages"], "und"], object)

        def fn(rows, data, offsets):
            n = rows.num_rows
            spoken = pc.match_substring_regex(rows.column("body").fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
            if not len(m["languages"]):
                return {"lang_pred": ["und"] * n, "score": np.zeros(n), "ambiguous": np.zeros(n, bool)}
            doc, at = grams.of(data, offsets)
            many = np.maximum(1, np.bincount(doc, minlength=n))
            w = m["weights"]
            margin = np.stack([np.bincount(doc, weights=w[at, b], minlength=n) for b in range(w.shape[1])], axis=1) * SCALE / many[:, None] + w[-1]
            loss = np.stack([(np.logaddexp(0, -margin * sign) * m["bit_weight"]).sum(axis=1) for sign in m["code"]], axis=1)
            chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
            chance /= chance.sum(axis=1, keepdims=True)
            best = np.where(spoken, np.argmax(chance, axis=1), len(names) - 1)
            ranked = np.sort(chance, axis=1)
            gap = ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)
            return {"lang_pred": pa.array(names[best], pa.string()), "score": np.where(spoken, ranked[:, -1], 0.0), "ambiguous": spoken & (gap < AMBIGUOUS)}

        return fn

    return add_columns(docs, make, "lang_pred string, score double, ambiguous boolean", text, keep)
