"""Ranked lexical search with two trees: hierarchies over items and documents hold coordinate maxima.

Every text is read once: a document keeps its length and the counts of those terms that
some item holds. A task takes these rows in batches; a batch is split into a tree
whose nodes hold, per term, the greatest weight of any document below. The items of a
block form such a tree of term weights. A pair of nodes is bounded by the product of
their maxima; where the bound is below the weakest k-th score of the node's
items, the whole pair is cut off, which loses nothing. Pairs of leaves are scored
exactly in the order of their bounds. All sums are integers below 2^53, so products
of doubles are exact.

A share of the documents (``PILOT``, by hash) is searched first; its k-th scores are lower
bounds for the search of all. A task gives at most k rows per item, so what is shuffled
does not depend on its rows. Items come in passes of bounded size (``PASS_TERMS``), in
blocks of ``BLOCK_ITEMS``.

Defined cases: null and empty texts have no terms and are never found; an item without
terms has no rows; the rows of one item id are one item with the terms of all; every
row of ``docs`` is ranked, rows that share an id too; equal scores go by ascending id,
a null id last; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .words import Words, add_columns, mix64, small_batches, tidy

PASS_TERMS, BLOCK_ITEMS, BLOCK_TERMS = 1 << 18, 256, 8192
#: One of so many documents is searched first; cells of a batch's matrix; rows of a leaf; coordinates that place the splits.
PILOT, BATCH_CELLS, DOC_LEAF, ITEM_LEAF, DIMS = 32, 1 << 22, 16, 4, 16


class Tree:
    """Rows split at medians down to leaves; ``levels[l]`` holds the coordinate maxima of the nodes of level l."""

    def __init__(self, rows: np.ndarray, leaf: int):
        n = len(rows)
        signs = (mix64(np.arange(rows.shape[1] * DIMS, dtype=np.uint64)) >> np.uint64(63)).astype(np.float32).reshape(-1, DIMS) * 2 - 1
        places = rows @ signs
        places /= np.maximum(1e-9, np.linalg.norm(places, axis=1, keepdims=True))
        self.order, edges = np.arange(n), [0, n]
        while max(np.diff(edges)) > leaf:
            cuts = []
            for a, b in zip(edges[:-1], edges[1:]):
                own = self.order[a:b]
                if b - a > 1:
                    x = places[own] - places[own].mean(axis=0)
                    along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
                    self.order[a:b] = own[np.argsort(along, kind="stable")]
                cuts += [a, (a + b) // 2]
            edges = [*cuts, n]
        self.edges = np.array(edges)
        # reduceat takes the row at the edge for an empty node, which only loosens its bound.
        level = np.maximum.reduceat(rows[self.order], np.minimum(self.edges[:-1], n - 1), axis=0)
        self.levels = [level]
        while len(level) > 1:
            level = np.maximum(level[0::2], level[1::2])
            self.levels.insert(0, level)


class Block:
    """Items with few enough terms for one matrix: their tree and, per node, its terms and greatest weights."""

    def __init__(self, numbers: list[int], terms: list[np.ndarray], weight: np.ndarray):
        self.numbers = np.array(numbers)
        self.terms = np.unique(np.concatenate(terms))
        rows = np.zeros((len(terms), len(self.terms)), np.float32)
        for i, own in enumerate(terms):
            rows[i, np.searchsorted(self.terms, own)] = weight[own]
        self.tree = Tree(rows, ITEM_LEAF)
        self.rows = rows[self.tree.order]
        self.numbers = self.numbers[self.tree.order]
        self.nodes = [[(np.flatnonzero(m), m[np.flatnonzero(m)].astype(float)) for m in level] for level in self.tree.levels]


class Searcher:
    """The k best of the documents seen so far, for all items of a pass."""

    def __init__(self, blocks: list[Block], least: np.ndarray, k: int):
        self.blocks, self.k = blocks, k
        self.best = np.zeros((len(least), k), np.int64)
        #: A document must reach this score: the k-th so far, or a bound known before.
        self.least = np.maximum(least, 1)
        self.pairs = self.scored = 0

    def _offer(self, numbers: np.ndarray, scores: np.ndarray) -> None:
        top = np.concatenate([self.best[numbers], scores.T], axis=1)
        self.best[numbers] = np.partition(top, top.shape[1] - self.k, axis=1)[:, -self.k :]
        self.least[numbers] = np.maximum(self.least[numbers], self.best[numbers].min(axis=1))

    def search(self, block: Block, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item number, row of ``docs``, score) of every candidate; ``docs`` are rows over the block's terms."""
        tree = Tree(docs, DOC_LEAF)
        docs, items = docs[tree.order], block.tree
        least = lambda l, i: self._weakest(block, l, i)
        level, frontier = 0, {0: np.array([0])}
        self.pairs += len(docs) * len(block.numbers)
        for depth in range(max(len(tree.levels), len(items.levels))):
            last = level
            level, at = min(depth, len(items.levels) - 1), min(depth, len(tree.levels) - 1)
            if depth:
                below = {}
                for i, nodes in frontier.items():
                    if at > depth - 1:
                        nodes = np.concatenate([2 * nodes, 2 * nodes + 1])
                    for child in (2 * i, 2 * i + 1) if level > last else (i,):
                        below[child] = nodes
                frontier = below
            kept, self.bounds = {}, {}
            for i, nodes in frontier.items():
                terms, weights = block.nodes[level][i]
                bound = tree.levels[at][nodes][:, terms] @ weights
                alive = bound >= least(level, i)
                if alive.any():
                    kept[i], self.bounds[i] = nodes[alive], bound[alive]
            frontier = kept
        found = [(np.zeros(0, np.int64),) * 3]
        for i, nodes in frontier.items():
            a, b = items.edges[i], items.edges[i + 1]
            if a == b:
                continue
            terms = block.nodes[level][i][0]
            weights, numbers = block.rows[a:b][:, terms].astype(float).T, block.numbers[a:b]
            order = np.argsort(-self.bounds[i], kind="stable")
            for first in range(0, len(order), 4):
                part = order[first : first + 4]
                part = part[self.bounds[i][part] >= self.least[numbers].min()]
                if not len(part):
                    break
                rows = np.concatenate([np.arange(tree.edges[n], tree.edges[n + 1]) for n in nodes[part]])
                if not len(rows):
                    continue
                scores = (docs[rows][:, terms] @ weights).astype(np.int64)
                self.scored += scores.size
                self._offer(numbers, scores)
                at, item = np.nonzero(scores >= self.least[numbers])
                found.append((numbers[item], tree.order[rows[at]], scores[at, item]))
        number, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        alive = score >= self.least[number]
        return number[alive], row[alive], score[alive]

    def _weakest(self, block: Block, level: int, node: int) -> int:
        width = len(block.tree.levels[-1]) // len(block.tree.levels[level])
        a, b = block.tree.edges[node * width], block.tree.edges[(node + 1) * width]
        return self.least[block.numbers[a:b]].min() if b > a else 1 << 62


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms) of every item with a term: the distinct hashes of its words."""

    def make():
        words = Words("alnum")

        def fn(rows, data, offsets):
            import pyarrow as pa

            doc, _, _, hashes = words.scan(data, offsets)
            cuts = np.searchsorted(doc, np.arange(len(offsets)))
            return {"terms": pa.array([np.unique(hashes[a:b].view(np.int64)) for a, b in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int64()))}

        return fn

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("body"))
    terms = add_columns(rows, make, "terms array<long>", "body", ["item_id"])
    terms = terms.select("item_id", F.explode("terms").alias("term")).distinct()
    return terms.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.count("term").alias("size"))


def count_terms(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text: str) -> DataFrame:
    """(id, n, terms, tf): the document's number of words, and the counts of those in the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        words, known = Words("alnum"), sent.value

        def fn(rows, data, offsets):
            doc, _, _, hashes = words.scan(data, offsets)
            many, hashes = len(offsets) - 1, hashes.view(np.int64)
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            hit = known[at] == hashes
            keys, tf = np.unique(doc[hit].astype(np.int64) * len(known) + at[hit], return_counts=True)
            cuts = np.searchsorted(keys, np.arange(many + 1) * len(known))
            terms, tf = (keys % len(known)).astype("<i4"), tf.astype("<i4")
            pairs = list(zip(cuts[:-1], cuts[1:]))
            return {"n": np.bincount(doc, minlength=many), "terms": [terms[a:b].tobytes() for a, b in pairs], "tf": [tf[a:b].tobytes() for a, b in pairs]}

        return fn

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("body"))
    return materialize(add_columns(rows, make, "n long, terms binary, tf binary", "body", ["id"]), "counts")


def statistics(counts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of every term of the vocabulary."""
    n_docs, length = counts.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()

    def count(batches):
        import pyarrow as pa

        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_terms)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df[terms])], ["term", "df"])

    found = counts.select("terms").mapInArrow(tidy(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return n_docs, length, df


def blocks_of(terms: list[np.ndarray]) -> list[list[int]]:
    """Item numbers in blocks of few enough items and terms (or one item)."""
    blocks, held = [[]], 0
    for i, own in enumerate(terms):
        if blocks[-1] and (len(blocks[-1]) == BLOCK_ITEMS or held + len(own) > BLOCK_TERMS):
            blocks.append([])
            held = 0
        blocks[-1].append(i)
        held += len(own)
    return blocks


def scan(counts: DataFrame, sent, n_docs: int, length: int, least: np.ndarray, k: int) -> DataFrame:
    """(item number, id, score): at least the k best of every task, per item."""
    kind = counts.schema["id"].dataType

    def run(batches):
        import pyarrow as pa

        terms, weight = sent.value
        blocks = [Block(b, [terms[i] for i in b], weight) for b in blocks_of(terms)]
        wide = max(len(b.terms) for b in blocks)
        searcher, kept = Searcher(blocks, least.copy(), k), None
        some = max(4 * DOC_LEAF, BATCH_CELLS // wide)

        def take(batch):
            n = batch.column("n").to_numpy()
            sizes = np.array([len(x) // 4 for x in batch.column("terms").to_pylist()], np.int64)
            row = np.repeat(np.arange(len(n)), sizes)
            term = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            tf = np.frombuffer(b"".join(batch.column("tf").to_pylist()), "<i4").astype(np.int64)
            m = 10 + (90 * n * n_docs) // length
            value = (1000000000 * tf) // (1000 * tf + 8 * m[row])
            parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for block in blocks:
                at = np.minimum(np.searchsorted(block.terms, term), len(block.terms) - 1)
                own = block.terms[at] == term
                docs = np.zeros((len(n), len(block.terms)), np.float32)
                docs[row[own], at[own]] = value[own]
                for part, made in zip(parts, searcher.search(block, docs), strict=True):
                    part.append(made)
            number, row, score = map(np.concatenate, parts)
            return pa.table({"number": number, "id": batch.column("id").take(pa.array(row)), "score": score})

        for batch in batches:
            for first in range(0, batch.num_rows, some):
                made = take(batch.slice(first, some))
                kept = made if kept is None else pa.concat_tables([kept, made])
                if kept.num_rows > 4 * k * len(least):
                    kept = best_of(kept, k)
        if kept is not None:
            yield from best_of(kept, k).to_batches()

    def best_of(table, k):
        import pyarrow as pa

        table = table.sort_by([("number", "ascending"), ("score", "descending"), ("id", "ascending")])
        number = table.column("number").to_numpy()
        place = np.arange(len(number)) - np.searchsorted(number, number)
        return table.filter(pa.array(place < k)).combine_chunks()

    schema = T.StructType([T.StructField("number", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    return counts.mapInArrow(tidy(run), schema)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; Spark cuts before the shuffle, too."""
    order = W.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_pass(docs: DataFrame, items: DataFrame, k: int, id_col: str, text: str) -> DataFrame:
    """The ranks of one bounded set of items (item_id, terms)."""
    spark = docs.sparkSession
    named = items.select("item_id", "terms").toArrow()
    found = [np.array(t, np.int64) for t in named.column("terms").to_pylist()]
    vocabulary = np.unique(np.concatenate(found))
    terms = [np.searchsorted(vocabulary, t) for t in found]
    # Neighbours in the list share a block and its tree.
    counts = count_terms(docs, vocabulary, id_col, text)
    n_docs, length, df = statistics(counts, len(vocabulary))
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))
    sent = spark.sparkContext.broadcast((terms, weight))
    counts = counts.filter(F.length("terms") > 0)
    none = np.zeros(len(terms), np.int64)
    pilot = counts.filter(F.pmod(F.xxhash64("id", "n", "terms"), F.lit(PILOT)) == 0)
    sure = top(scan(pilot, sent, n_docs, length, none, k), k).filter(F.col("rank") == k).select("number", "score").toArrow()
    least = none.copy()
    least[sure.column("number").to_numpy()] = sure.column("score").to_numpy()
    ranked = top(scan(counts, sent, n_docs, length, least, k), k)
    import pyarrow as pa

    names = spark.createDataFrame(pa.table({"number": np.arange(len(terms)), "item_id": named.column("item_id")}))
    names = names.select("number", F.col("item_id").cast(items.schema["item_id"].dataType))
    return ranked.join(F.broadcast(names), "number").select("item_id", "rank", F.col("id").alias(id_col), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, id and score of the k best documents of every item, passes of items united."""
    spark = docs.sparkSession
    small_batches(spark)
    found = materialize(item_terms(items, item_id, item_text), "item-terms")
    total = found.agg(F.sum("size")).first()[0] or 0
    passes = -(-total // PASS_TERMS)
    schema = T.StructType([T.StructField("item_id", found.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.LongType())])
    out = None
    for number in range(passes):
        part = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number) if passes > 1 else found
        if passes > 1 and part.isEmpty():
            continue
        made = search_pass(docs, part, k, id_col, text)
        out = made if out is None else out.unionByName(made)
    return spark.createDataFrame([], schema) if out is None else out
