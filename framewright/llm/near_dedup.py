"""Near-duplicate documents by DartMinHash signatures over weighted word shingles.

A document is a multiset of five-word shingles (A-Z lower-cased; ASCII letters, digits
and bytes from 0x80 are words; a shorter text is one shingle). Every unit of a
shingle's weight is a region at which hashed darts are thrown, rank cell by rank cell:
their number is Poisson, their rank and coordinate are hashes. A document keeps the
earliest dart of each coordinate and stops once all have one, so the chance that two
coordinates agree is the weighted Jaccard similarity.

Texts of equal words share a node. Nodes that agree in a band meet in a bucket and are
linked if their signatures agree enough (a loose bound); the components of those links
are then decided exactly on the shingles, and the exact links' components are the
classes.

Defined cases: a document without words (null, empty, signs only) is its own class;
equal word sequences are one class; the class id is its smallest document id; a
document without an id takes part and never names a class unless all ids are null; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .groups import components, few, linked_members
from .words import Words, add_columns, mix64, tidy, windows

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 4: a pair of similarity 0.8 misses all bands once in 36,000 pairs.
BANDS, ROWS = 20, 4
#: Signatures that agree less are no candidates: 4.5 standard deviations below 0.8.
LOOSE = 0.6
#: Ranks below 2**FIRST_CELL are one cell, then each cell doubles the rank.
FIRST_CELL = -12


def shingles(words: Words, data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, element) of each unit of shingle weight, then (words of each document, word hashes, first word)."""
    doc, _, _, h = words.scan(data, offsets)
    many = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(many)])
    at, gram = windows(h, doc, k)
    gram_doc = doc[at]
    short = np.flatnonzero((many > 0) & (many < k))
    if len(short):
        whole = [windows(h[first[i] : first[i + 1]], np.zeros(many[i], np.int64), int(many[i]))[1] + np.uint64(many[i]) for i in short]
        gram, gram_doc = np.concatenate([gram, *whole]), np.concatenate([gram_doc, short])
    # The nth copy of a shingle in a document is the nth unit of its weight.
    key = mix64(gram + mix64(gram_doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, gram, gram_doc = key[order], gram[order], gram_doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return gram_doc, mix64(gram + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), many, h, first


def _poisson(rate: float) -> np.ndarray:
    """Cumulated Poisson chances as bounds for a uniform 64-bit integer."""
    n = int(rate + 12 * rate**0.5 + 20)
    steps = np.log(rate) - np.log(np.arange(1, n))
    chance = np.exp(np.concatenate([[0], np.cumsum(steps)]) - rate)
    return np.minimum(np.cumsum(chance) * 2.0**64, 2.0**64 - 4096).astype(np.uint64)


def throw_darts(doc: np.ndarray, element: np.ndarray, n_docs: int, coordinates: int) -> np.ndarray:
    """Signatures (documents x coordinates) of 32-bit dart names, 0 rows for documents without elements."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_docs * coordinates, none)
    active = np.zeros(n_docs, bool)
    active[doc] = True
    cell = FIRST_CELL
    while len(doc):
        low, high = (0.0 if cell == FIRST_CELL else 2.0 ** (cell - 1)), 2.0**cell
        seed = mix64(element + np.uint64((cell + 64) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        bounds = _poisson(coordinates * (high - low))
        hit = np.flatnonzero(seed >= bounds[0])
        many = np.searchsorted(bounds, seed[hit], "right")
        which = np.repeat(hit, many)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        dart = mix64(mix64(seed[which]) + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        rank = low + (high - low) * ((dart >> np.uint64(32)).astype(np.float64) / 2.0**32)
        name = mix64(dart + np.uint64(1))
        slot = doc[which] * coordinates + (name % np.uint64(coordinates)).astype(np.int64)
        # Rank (to 2**-24 of the cell's bound) above the dart's name: the least value is the earliest dart.
        value = (np.uint64(cell + 64) << np.uint64(56)) | ((rank / high * 2.0**24).astype(np.uint64) << np.uint64(32)) | (name >> np.uint64(32))
        np.minimum.at(best, slot, value)
        active &= (best == none).reshape(n_docs, coordinates).any(axis=1)
        stay = active[doc]
        doc, element = doc[stay], element[stay]
        cell += 1
    out = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n_docs, coordinates)
    out[(best == none).reshape(n_docs, coordinates).all(axis=1)] = 0
    return out


def sketch(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text_key, node, signature, weight) of each document; node and signature are null without words."""

    def make():
        words = Words("alnum")

        def fn(rows, data, offsets):
            doc, element, many, h, first = shingles(words, data, offsets)
            signature = throw_darts(doc, element, rows.num_rows, BANDS * ROWS)
            return {
                "node": [hashlib.blake2b(h[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() if many[i] else None for i in range(rows.num_rows)],
                "signature": [s.tobytes() if n else None for s, n in zip(signature, many, strict=True)],
                "weight": np.bincount(doc, minlength=rows.num_rows),
            }

        return fn

    source = docs.select(F.col(id_col).alias("id"), _text_key(text).alias("text_key"), F.col(text).alias("body"))
    return add_columns(source, make, "node binary, signature binary, weight long", "body", ["id", "text_key"])


def _text_key(text: str) -> Column:
    """What tells rows apart that share an id, or have none."""
    return F.xxhash64(F.col(text).cast("string"))


def _by_signature(payloads: list[bytes]):
    s = np.frombuffer(b"".join(payloads), np.uint32).reshape(len(payloads), -1)
    first = 0
    if len(s) > 8:  # start from the member that agrees most with each coordinate's commonest value
        agree = np.zeros(len(s))
        for c in range(s.shape[1]):
            _, at, many = np.unique(s[:, c], return_inverse=True, return_counts=True)
            agree += many[at] == many.max()
        first = int(np.argmax(agree))
    return first, lambda p: (s == s[p]).mean(axis=1) >= LOOSE


def _by_shingles(payloads: list[bytes]):
    size = np.array([len(p) // 8 for p in payloads])
    value = np.frombuffer(b"".join(payloads), np.uint64)
    owner = np.repeat(np.arange(len(payloads)), size)
    start = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(value, kind="stable")
    ranked, owner_of = value[order], owner[order]
    common, back = np.unique(value, return_inverse=True)
    spread = np.bincount(back)
    # Start from the member with the largest share of shingles that most members have.
    usual = np.bincount(owner, weights=(2 * spread[back] > len(payloads)), minlength=len(payloads))
    first = int(np.argmax(usual / np.maximum(1, size)))

    def similar(p: int) -> np.ndarray:
        own = value[start[p] : start[p + 1]]
        a, b = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        many = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        shared = np.bincount(owner_of[at], minlength=len(payloads))
        return shared >= SIMILARITY * (size + size[p] - shared) - 1e-9

    return first, similar


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links between nodes whose signatures share a band and agree in LOOSE of the coordinates."""

    def bands(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.zeros(s.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for r in range(ROWS):
                key = mix64(key * np.uint64(0x9FB21C651E98DF25) + s[:, :, r])
            at = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(at)], ["group", "node"])

    keyed = nodes.select("node", "signature").mapInArrow(tidy(bands), "group long, node binary")
    shared = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keyed.join(shared.select("group"), "group").join(nodes.select("node", F.col("signature").alias("payload")), "node")
    return linked_members(members.withColumn("weight", F.lit(1).cast("long")), shared.withColumn("total", F.col("n")), _by_signature)


def exact_links(docs: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str, text: str) -> DataFrame:
    """Links of similarity SIMILARITY or more inside the candidate components."""
    # One text for each node: that of its best row.
    wanted = materialize(few(nodes.join(roots, "node").select("node", F.xxhash64("root").alias("group"), "best.id", "best.text_key", "weight")), "candidates")
    sizes = wanted.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"))

    def make():
        words = Words("alnum")

        def fn(rows, data, offsets):
            doc, element, many, h, first = shingles(words, data, offsets)
            order = np.argsort(doc, kind="stable")
            element, edge = element[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=rows.num_rows))])
            return {
                "own": [hashlib.blake2b(h[first[i] : first[i + 1]].tobytes(), digest_size=16).digest() for i in range(rows.num_rows)],
                "payload": [element[edge[i] : edge[i + 1]].tobytes() for i in range(rows.num_rows)], "weight": np.diff(edge),
            }

        return fn

    source = docs.select(F.col(id_col).alias("id"), _text_key(text).alias("text_key"), F.col(text).alias("body"))
    # The texts move at every size: broadcasting a small side would only pay for small inputs.
    same = source["id"].eqNullSafe(wanted["id"]) & (source["text_key"] == wanted["text_key"])
    texts = source.join(wanted.hint("merge"), same).select("group", "node", "body")
    rows = add_columns(texts, make, "own binary, payload binary, weight long", "body", ["group", "node"]).filter("own = node")
    # Rows that are repeated whole bring one text several times.
    return linked_members(rows.drop("own").dropDuplicates(["group", "node"]), sizes, _by_shingles)


def _classes(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_key, node) of every row; and of every node its class: (node, best, class_id).

    ``best`` is the row that stands for the class: least id (none last), then text_key.
    """
    sketched = materialize(sketch(docs, id_col, text), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_key")).alias("best")
    # Copies meet here, map-side first; nothing below sees more than one row per node.
    nodes = materialize(sketched.filter("node is not null").groupBy("node").agg(
        best, F.first("weight").alias("weight"), F.first("signature").alias("signature")), "nodes")
    roots = materialize(few(components(candidate_links(nodes))), "candidate-roots")
    classes = components(exact_links(docs, nodes, roots, id_col, text))
    # A node without links is its own component.
    named = nodes.select("node", "best").join(classes, "node", "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    # Written, so that joins may split the rows of a node with very many copies.
    final = named.join(named.groupBy("root").agg(F.min("best").alias("top")), "root").select("node", F.col("top").alias("best"), F.col("top.id").alias("class_id"))
    return sketched.select("id", "text_key", "node"), materialize(few(final), "classes")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``class_id``, the smallest id of its class."""
    kind = docs.schema[id_col].dataType
    sketched, final = _classes(docs, id_col, text)
    out = sketched.select("id", "node").join(final, "node", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).cast(kind).alias("class_id"))


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: that with the smallest id (of those without an id, any one).

    The decision is the row's, not the id's: of rows that share an id, each stays or
    goes with its own class. Documents without words stay. Rows that share id and
    text stay once.
    """
    sketched, classes = _classes(docs, id_col, text)
    first = classes.select("best.id", "best.text_key").distinct().unionByName(sketched.filter("node is null").select("id", "text_key").distinct())
    copies = sketched.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    first = materialize(few(first.withColumnsRenamed({"id": "first_id", "text_key": "first_key"})), "first-rows")
    same = docs[id_col].eqNullSafe(first["first_id"]) & (_text_key(text) == first["first_key"])
    kept = docs.join(first, same, "left_semi")
    if copies.filter("n > 1").isEmpty():  # no rows share id and text
        return kept
    return kept.withColumn("_text_key", _text_key(text)).dropDuplicates([id_col, "_text_key"]).drop("_text_key")
