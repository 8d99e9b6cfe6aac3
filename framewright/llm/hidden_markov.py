"""Hidden Markov language model: Baum-Welch counts from all partitions, exact forward scores.

Tokens are words without white space (A-Z lower-cased) and one end token per text; a
token is known by its 64-bit hash. Latent states emit token classes (``CLASSES`` hash
buckets and the end), and a class emits its tokens by their counts:

    P(token | state) = emission[state, class] * (c + 1) / (C + V + 1)

with c the token's training count, C and V the count and the number of distinct known
tokens of its class; an unknown token takes the share that is left. The first guess
comes from the class counts of all training texts. ``SHARES`` Baum-Welch rounds follow, each
over another share of the texts (together all of them once), then ``ROUNDS`` rounds over
all. Expected counts are summed across partitions; for these counts only, texts are cut
into runs of ``RUN`` tokens. A text's first run begins in the start state, which is
learnt from first runs alone; later runs begin in the stationary state. A score is the
log10 probability of the whole token sequence by the scaled forward recursion.

The token counts stay a distributed table. Texts are dealt to batches of about
``BATCH_BYTES``; each batch asks for its distinct tokens once, and gets their counts
back beside its texts.

Defined cases: a null or empty text is the end token alone; texts that don't train
(held out, or without an id) are scored all the same; without training texts every
count is 0 and the states are equal; rows that share an id are scored each; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, mix64, sliced, small_batches, text_bytes, tidy

STATES, CLASSES, RUN = 6, 4096, 64
SHARES, ROUNDS = 8, 2
BATCH_BYTES = 6 << 20
END_HASH = 0x0E0D0E0D0E0D0E0D
END, PAD = CLASSES, CLASSES + 1


def token_hashes(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text), ends included."""
    doc, _, _, h = words.scan(data, offsets)
    many = np.bincount(doc, minlength=len(offsets) - 1) + 1
    first = np.concatenate([[0], np.cumsum(many)])
    out = np.full(first[-1], END_HASH, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, first


def token_class(h: np.ndarray) -> np.ndarray:
    return np.where(h == np.uint64(END_HASH), END, (mix64(h) >> np.uint64(52)).astype(np.int64) % CLASSES)


def runs(classes: np.ndarray, first: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(runs x run classes, padded; first run of each text)."""
    length = np.diff(first)
    per_text = -(-length // run)
    start = np.concatenate([[0], np.cumsum(per_text)])
    grid = np.full(int(start[-1]) * run, PAD, np.int64)
    text = np.repeat(np.arange(len(length)), length)
    grid[start[text] * run + np.arange(len(classes)) - first[text]] = classes
    return grid.reshape(-1, run), start


class Model:
    """start (before the first token), transitions, and emissions by class (a row of ones for padding)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def from_counts(counts: np.ndarray) -> Model:
        """``counts``: rows for start, for each state's transitions, for each class."""
        k = counts.shape[1]
        start, move, emit = counts[0] + 1.0, counts[1 : 1 + k] + 1.0, counts[1 + k :].copy()
        share = (emit.sum(axis=1, keepdims=True) + 1.0) / (emit.sum() + len(emit))
        emit = emit + 20.0 * share
        emit[PAD:] = 0
        emit /= emit.sum(axis=0)
        emit[PAD:] = 1
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit)

    @staticmethod
    def uneven(class_counts: np.ndarray) -> Model:
        """A first guess: sticky states whose emissions differ by a hashed factor."""
        share = class_counts[: PAD + 1] + 0.1
        noise = (mix64(np.arange((PAD + 1) * STATES, dtype=np.uint64)) >> np.uint64(11)).astype(float).reshape(-1, STATES) / 2.0**53
        emit = share[:, None] * (0.25 + noise)
        emit[PAD] = 0
        emit /= emit.sum(axis=0)
        emit[PAD] = 1
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) if STATES > 1 else np.ones((1, 1))
        np.fill_diagonal(move, 0.9 if STATES > 1 else 1.0)
        return Model(np.full(STATES, 1 / STATES), move, emit)

    def stationary(self) -> np.ndarray:
        state = self.start
        for _ in range(100):
            state = state @ self.move
        return state / state.sum()

    def expected(self, grid: np.ndarray, opens: np.ndarray | None = None) -> np.ndarray:
        """Baum-Welch counts of the runs, laid out as ``from_counts`` takes them. ``opens``: which runs begin a text (all by default)."""
        n, t = grid.shape
        k = len(self.start)
        out = np.zeros((1 + k + PAD + 1, k))
        if not n:
            return out
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        seen = np.ascontiguousarray(emit[grid.T])
        alpha = np.empty((t + 1, n, k), np.float32)
        opens = np.ones(n, bool) if opens is None else opens
        alpha[0] = np.where(opens[:, None], self.start, self.stationary())
        for i in range(t):
            a = alpha[i] @ move * seen[i]
            alpha[i + 1] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
        beta = np.full((n, k), 1.0, np.float32)
        real = grid.T != PAD
        gamma = np.empty((t, n, k), np.float32)
        moved = np.zeros((k, k))
        for i in range(t - 1, -1, -1):
            g = alpha[i + 1] * beta
            gamma[i] = g / np.maximum(g.sum(axis=1, keepdims=True), 1e-30)
            below = seen[i] * beta
            back = below @ move.T
            scale = np.maximum((alpha[i] * back).sum(axis=1, keepdims=True), 1e-30)
            moved += (alpha[i] * (real[i][:, None] / scale)).T @ below
            beta = back / np.maximum(back.sum(axis=1, keepdims=True), 1e-30) * k
        first = (alpha[0] * beta)[opens]
        out[0] = (first / np.maximum(first.sum(axis=1, keepdims=True), 1e-30)).sum(axis=0)
        out[1 : 1 + k] = moved * self.move
        flat = grid.T.reshape(-1)
        for s in range(k):
            out[1 + k :, s] = np.bincount(flat, weights=gamma[:, :, s].reshape(-1), minlength=PAD + 1)
        out[1 + k + PAD] = 0
        return out

    def log10(self, grid: np.ndarray, start: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text's classes.

        The forward recursion in double precision: each run's product of transition
        and emission steps, scaled after every step, then the runs of a text in order.
        """
        n, k = len(grid), len(self.start)
        step = np.broadcast_to(np.eye(k), (n, k, k)).copy()
        scale = np.zeros(n)
        for i in range(grid.shape[1]):
            step = (step.reshape(n * k, k) @ self.move).reshape(n, k, k) * self.emit[grid[:, i]][:, None, :]
            size = step.max(axis=(1, 2))
            step /= size[:, None, None]
            scale += np.log10(size)
        many = np.diff(start)
        state = np.broadcast_to(self.start, (len(many), k)).copy()
        total = np.zeros(len(many))
        for j in range(int(many.max()) if len(many) else 0):
            on = np.flatnonzero(many > j)
            at = start[on] + j
            v = np.einsum("nk,nkl->nl", state[on], step[at])
            size = v.sum(axis=1)
            state[on] = v / size[:, None]
            total[on] += np.log10(size) + scale[at]
        return total


def _texts(docs: DataFrame, trains: Column, id_col: str, text: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    return source.withColumn("trains", F.coalesce(trains, F.lit(False)))


def train(texts: DataFrame) -> Model:
    """Baum-Welch over the training texts (columns id, body, trains)."""
    learning = texts.filter("trains").select("id", "body")
    shape = (1 + STATES + PAD + 1, STATES)

    def summed(rows: DataFrame, size: tuple, work) -> np.ndarray:
        """``work(hashes, first tokens)`` of all slices, added up by task, then by 16 tasks, then here."""

        def count(batches):
            words, total = Words("solid"), np.zeros(size)
            for batch in batches:
                for _, data, offsets in sliced(batch, "body"):
                    total += work(*token_hashes(words, data, offsets))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

        def add(batches):
            total = np.zeros(size)
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total += np.frombuffer(raw).reshape(size)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

        sums = rows.mapInArrow(tidy(count), "counts binary").repartition(16).mapInArrow(add, "counts binary").collect()
        return sum((np.frombuffer(r["counts"]).reshape(size) for r in sums), np.zeros(size))

    def round_over(rows: DataFrame, model: Model) -> Model:
        held = texts.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit))

        def work(h, first):
            current, total = Model(*held.value), np.zeros(shape)
            grid, begin = runs(token_class(h), first)
            opens = np.zeros(len(grid), bool)
            opens[begin[:-1]] = True
            pieces = max(1, len(grid) // 4000)
            for part, at in zip(np.array_split(grid, pieces), np.array_split(opens, pieces), strict=True):
                total += current.expected(part, at)
            return total

        counts = summed(rows, shape, work)
        return Model.from_counts(counts) if counts.any() else model  # a share may have no texts

    classes = summed(learning, (PAD + 1,), lambda h, first: np.bincount(token_class(h), minlength=PAD + 1))
    if not classes.any():
        return Model.from_counts(np.zeros(shape))
    model = Model.uneven(classes)
    share = F.pmod(F.xxhash64("id", F.octet_length("body"), F.lit("share")), F.lit(SHARES))
    for number in range(SHARES):
        model = round_over(learning.filter(share == number), model)
    for _ in range(ROUNDS):
        model = round_over(learning, model)
    return model


def count_tokens(dealt: DataFrame) -> DataFrame:
    """(batch, token, n): each batch's distinct tokens and their count in its training texts."""

    def count(table):
        words = Words("solid")
        trains = table.column("trains").to_numpy()
        data, offsets = text_bytes(table.column("body").combine_chunks())
        h, first = token_hashes(words, data, offsets)
        token, at = np.unique(h, return_inverse=True)
        n = np.bincount(at, weights=np.repeat(trains, np.diff(first)), minlength=len(token))
        batch = table.column("batch")[0].as_py()
        return pa.table({"batch": pa.array(np.full(len(token), batch)), "token": token.view(np.int64), "n": n.astype(np.int64)})

    return dealt.groupBy("batch").applyInArrow(count, "batch long, token long, n long")


def score_texts(docs: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score. ``trains``: over a column ``id``."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, trains, id_col, text)
    kind = docs.schema[id_col].dataType.simpleString()
    size = texts.agg(F.sum(F.octet_length("body") + F.lit(1))).first()[0] or 0
    model = train(texts)
    dealt = texts.withColumn("batch", F.pmod(F.xxhash64("id", "body"), F.lit(max(1, -(-size // batch_bytes)))))
    asked = materialize(count_tokens(dealt), "batch-tokens")
    known = asked.groupBy("token").agg(F.sum("n").alias("c"))
    asked_counts = materialize(asked.select("batch", "token").join(known, "token"), "token-counts")
    per_class = _class_totals(known)
    held = spark.sparkContext.broadcast(((model.start, model.move, model.emit), per_class))

    def score(left, right):
        (start, move, emit), (total, distinct) = held.value
        words, m = Words("solid"), Model(start, move, emit)
        out = []
        token = right.column("token").to_numpy().view(np.uint64)
        order = np.argsort(token)
        token, c = token[order], right.column("c").to_numpy()[order]
        n_all, v_all = int(total.sum()), int(distinct.sum())
        for batch in left.combine_chunks().to_batches():
            for rows, data, offsets in sliced(batch, "body"):
                h, first = token_hashes(words, data, offsets)
                own = c[np.searchsorted(token, h)]
                classes = token_class(h)
                grid, run_start = runs(classes, first)
                inside = np.log10((own + 1) / (total[classes] + distinct[classes] + 1))
                inside[classes == END] = 0.0
                base = np.log10((own + 1) / (n_all + v_all + 1))
                parts = [np.add.reduceat(x, first[:-1]) for x in (base, inside, (own > 0).astype(np.int64))]
                out.append(pa.table({
                    "id": rows.column("id"), "n_tokens": np.diff(first), "n_known": parts[2],
                    "train_tokens": np.full(rows.num_rows, n_all), "base_score": parts[0], "score": m.log10(grid, run_start) + parts[1],
                }))
        return pa.concat_tables(out)

    fields = f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = dealt.groupBy("batch").cogroup(asked_counts.groupBy("batch")).applyInArrow(score, fields)
    return scored.withColumnRenamed("id", id_col)


def _class_totals(known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and distinct training tokens of each class (CLASSES + 1 rows at most)."""

    def classify(rows):
        def fn(batch):
            return token_class(batch.to_numpy(zero_copy_only=False).view(np.uint64))

        for batch in rows:
            yield pa.RecordBatch.from_arrays([pa.array(fn(batch.column(0))), batch.column(1)], ["class", "c"])

    seen = known.filter("c > 0").select("token", "c").mapInArrow(classify, "class long, c long")
    total, distinct = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in seen.groupBy("class").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("distinct")).collect():
        total[r["class"]], distinct[r["class"]] = r["total"], r["distinct"]
    return total, distinct
