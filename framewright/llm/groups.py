"""Links inside groups of any size, and connected components, without all-pairs output."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import tidy

CHUNK_ROWS, CHUNK_WEIGHT = 1500, 1_500_000


def forest(n: int, first: int, similar: Callable[[int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(component label of each member, members that are not similar to ``first``).

    Every pair is decided: two members that are both similar to ``first`` are
    connected through it, and any other member is compared with all.
    """
    label = np.arange(n)

    def union(p: int, mask: np.ndarray) -> None:
        mask = mask.copy()
        mask[p] = True
        old = np.unique(label[mask])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]

    near = similar(first)
    union(first, near)
    near[first] = True
    others = np.flatnonzero(~near)
    for p in others:
        union(int(p), similar(int(p)))
    return label, others


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def key(batch, i):
        return [batch.column(c)[i].as_py() for c in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            column = batch.column(c).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def linked_members(rows: DataFrame, sizes: DataFrame, compare: Callable, level: int = 0) -> DataFrame:
    """Links (a, b) that connect the similar members of each group.

    ``rows``: group long, node binary, payload binary, weight long.
    ``sizes``: group, n (members), total (weight), for the groups of two or more.
    ``compare(payloads) -> (first, similar)`` prepares a chunk: the member to start
    from and the test of one member against all. A group beyond a chunk's size is cut
    into chunks; the members that a chunk's first member does not reach visit all
    chunks of the group, and the first members meet as a smaller group of their own.
    Chunks whose first members are still apart after that meet pair by pair, so that
    no link is lost and no task holds a whole group.
    """
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("total") / CHUNK_WEIGHT)).cast("long")
    dealt = rows.join(sizes.select("group", chunks.alias("chunks")), "group").withColumn(
        "chunk", F.pmod(F.xxhash64("node", "group", F.lit(level)), F.col("chunks")))

    def run(batches):
        for members in by_group(batches, 2):
            n = members.num_rows
            nodes, chunks = members.column("node").to_pylist(), members.column("chunks")[0].as_py()
            visits = members.column("visits").to_numpy()
            if n == 1 and chunks == 1 or chunks > 1 and visits.all():
                continue
            first, similar = compare(members.column("payload").to_pylist())
            if visits.any():
                label, others, pairs = np.arange(n), [], []
                for p in np.flatnonzero(visits):  # links that connect, not all pairs
                    near = np.flatnonzero(similar(int(p)) & ~visits)
                    old, at = np.unique(label[near], return_index=True)
                    pairs += [(int(p), int(q)) for q in near[at[old != label[p]]]]
                    label[np.isin(label, np.append(old, label[p]))] = label[p]
            else:
                label, others = forest(n, first, similar)
                pairs = [(i, int(r)) for i, r in enumerate(label) if r != i]
            out = [(members.column("group")[0].as_py(), "link", chunks, nodes[i], nodes[j], None, 0) for i, j in pairs]
            if chunks > 1 and not visits.any():
                out += [(members.column("group")[0].as_py(), role, chunks, nodes[i], None, members.column("payload")[i].as_py(), members.column("weight")[i].as_py())
                        for role, listed in (("first", [first]), ("other", others)) for i in map(int, listed)]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    schema = pa.schema([("group", pa.int64()), ("role", pa.string()), ("chunks", pa.int64()), ("a", pa.binary()), ("b", pa.binary()),
                        ("payload", pa.binary()), ("weight", pa.int64())])
    ddl = "group long, role string, chunks long, a binary, b binary, payload binary, weight long"

    def cluster(frame: DataFrame) -> DataFrame:
        columns = frame.select("group", "chunk", "chunks", "node", "payload", "weight", "visits")
        return columns.repartition("group", "chunk").sortWithinPartitions("group", "chunk").mapInArrow(tidy(run), ddl)

    made = materialize(cluster(dealt.withColumn("visits", F.lit(False))), "group-links")
    links = made.filter("role = 'link'").select("a", "b")
    wide = made.filter("role <> 'link'")
    if wide.isEmpty():
        return links
    others = wide.filter("role = 'other'").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    visitors = others.select("group", "chunk", "chunks", F.col("a").alias("node"), "payload", "weight", F.lit(True).alias("visits"))
    hosts = dealt.filter("chunks > 1").join(wide.filter("role = 'other'").select("group").distinct(), "group", "left_semi")
    met = cluster(hosts.withColumn("visits", F.lit(False)).select(*visitors.columns).unionByName(visitors))
    firsts = wide.filter("role = 'first'").select("group", F.col("a").alias("node"), "payload", "weight")
    # First members too heavy to share a chunk would not meet above either: their chunks meet in pairs at once.
    counted = firsts.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")).filter(f"n > 1 and total * 2 < n * {CHUNK_WEIGHT}")
    above = linked_members(firsts, counted, compare, level + 1)
    links = materialize(made.filter("role = 'link' and chunks > 1").select("a", "b").unionByName(
        met.filter("role = 'link'").select("a", "b")).unionByName(above), "chunk-links")
    near = dealt.filter("chunks > 1").join(others.select("group", F.col("a").alias("node")).distinct(), ["group", "node"], "left_anti")
    heads = wide.filter("role = 'first'").select("group", F.col("a").alias("node"), "chunks")
    heads = heads.withColumn("chunk", F.pmod(F.xxhash64("node", "group", F.lit(level)), F.col("chunks")))
    return made.filter("role = 'link' and chunks = 1").select("a", "b").unionByName(links).unionByName(_bridges(near, heads, links, compare))


def _bridges(near: DataFrame, heads: DataFrame, links: DataFrame, compare: Callable) -> DataFrame:
    """Links between chunks whose first members (``heads``) the known links leave apart.

    All ``near`` members of a chunk belong to its first one's component, so one link joins
    a pair of chunks. Every pair of two components meets; there is nothing to repeat.
    """
    apart = heads.join(components(links), "node", "left").select("group", "chunk", F.coalesce("root", "node").alias("root"))
    apart = materialize(few(apart), "chunk-roots")
    pairs = apart.alias("v").join(apart.alias("h"), F.expr("v.group = h.group and v.root < h.root")).select(
        "v.group", F.col("v.chunk").alias("visitor"), F.col("h.chunk").alias("host"))
    ends = F.array(F.struct(F.col("visitor").alias("chunk"), F.lit(True).alias("visits")), F.struct(F.col("host").alias("chunk"), F.lit(False).alias("visits")))
    pairs = pairs.select("group", F.format_string("%d-%d", "visitor", "host").alias("pair"), F.explode(ends).alias("end")).select("group", "pair", "end.*")
    pairs = materialize(few(pairs), "chunk-pairs")
    if pairs.isEmpty():
        return links.limit(0)

    def run(batches):
        for members in by_group(batches, 2):
            visits = members.column("visits").to_numpy()
            _, similar = compare(members.column("payload").to_pylist())
            nodes = members.column("node")
            for p in np.flatnonzero(visits):
                met = np.flatnonzero(similar(int(p)) & ~visits)
                if len(met):
                    yield pa.RecordBatch.from_pydict({"a": [nodes[int(p)].as_py()], "b": [nodes[int(met[0])].as_py()]}, pa.schema([("a", pa.binary()), ("b", pa.binary())]))
                    break

    meeting = near.join(pairs, ["group", "chunk"]).select("group", "pair", "node", "payload", "visits")
    return meeting.repartition("group", "pair").sortWithinPartitions("group", "pair").mapInArrow(tidy(run), "a binary, b binary")


def few(df: DataFrame) -> DataFrame:
    """A small table in few partitions, so that writing it takes few files."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the smallest node of its component.

    Alternating star contraction: neighbours move to the smallest neighbour until the
    edges stay as they are. Each round writes its edges, which cuts the lineage.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(few(edges), "edges")
    seen = None
    while True:
        digest = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if digest == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = digest
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join below may split the rows of a hub with very many neighbours.
        least = materialize(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(few(large), "edges")
        low = materialize(few(large.groupBy("u").agg(F.min("v").alias("m"))), "least")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = materialize(few(small.filter("u <> v").distinct()), "edges")
