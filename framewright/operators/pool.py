"""Speaker pool: filters, seeded draws, averaged pseudospeakers and pooled pitch statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import rng
from framewright.operators.scans import bounded_broadcast, number_rows
from framewright.session import materialize

GENDERS = ("f", "m")
SPARSE = "cluster_sparse"
DENSE = "cluster_dense"
POOL_LIMIT = 256 << 20  # bytes of pool vectors that may be sent to every task
_SMALL = 64 << 20
CHUNK, BUNDLE = 1024, 1024  # candidates and requests that meet in one piece of work
TASK_DRAWS = 32 << 20  # draws of one task, about
_PIECE = 16384  # draws that are walked together


def _mean_vector(col: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(col).cast("array<double>"))))


def pool_filter(pool: DataFrame, gender: str | None = None, cluster: int | None = None) -> DataFrame:
    """Speakers of a gender and/or of a cluster; None means no restriction."""
    if gender not in (None, "any"):
        pool = pool.filter(F.col("gender") == gender)
    if cluster is not None:
        pool = pool.filter(F.col("cluster") == cluster)
    return pool


def cluster_gender(pool: DataFrame, clusters: DataFrame) -> DataFrame:
    """Each cluster takes the gender of its centre speaker."""
    centres = pool.select(F.col("speaker_id").alias("centre_speaker"), "gender")
    return clusters.join(centres, "centre_speaker")


def genders_of_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("gender").agg(F.count(F.lit(1)).alias("n_clusters"))


def draw_gender(seed: Column) -> Column:
    """Gender drawn from the seed with equal chances."""
    return F.when(rng.uniform(seed, F.lit("gender")) < 0.5, GENDERS[0]).otherwise(GENDERS[1])


def candidate_clusters(clusters: DataFrame, criterion: str, top_n: int = 10) -> DataFrame:
    """The ``top_n`` sparsest (or densest) clusters of each gender, numbered from 0.

    The number always follows ascending density, as the shortlist is a slice of
    the density order.
    """
    if criterion not in (SPARSE, DENSE):
        raise ValueError(f"criterion must be {SPARSE} or {DENSE}, got {criterion}")
    ranked = number_rows(clusters, ["density_pos"], ["gender"], out="_rank")
    sizes = ranked.groupBy("gender").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(sizes, "gender")
    skip = F.lit(0) if criterion == SPARSE else F.greatest(F.col("_n") - top_n, F.lit(0))
    return (
        ranked.withColumn("pick", F.col("_rank") - skip)
        .filter((F.col("pick") >= 0) & (F.col("pick") < top_n))
        .withColumn("n_picks", F.least(F.col("_n"), F.lit(top_n)))
        .drop("_rank", "_n")
    )


def choose_cluster(
    requests: DataFrame, clusters: DataFrame, criterion: str, top_n: int = 10
) -> DataFrame:
    """Add one cluster to every request (seed, gender): a uniform pick from the shortlist.

    The draw is an index into the shortlist, so the join is an equi-join on
    (gender, index) and emits one row per request.
    """
    short = candidate_clusters(clusters, criterion, top_n).select("gender", "pick", "n_picks", "cluster")
    sizes = short.groupBy("gender").agg(F.max("n_picks").alias("_n"))
    drawn = requests.join(bounded_broadcast(sizes, F.lit(64), _SMALL), "gender").withColumn(
        "pick", F.floor(rng.uniform(F.col("seed"), F.lit("cluster")) * F.col("_n")))
    picks = bounded_broadcast(short.drop("n_picks"), F.lit(64), _SMALL)
    return drawn.drop("_n").join(picks, ["gender", "pick"]).drop("pick")


def _draw_indices(n: Column, size: Column) -> Column:
    """``n`` distinct indices below ``size`` by Floyd's algorithm; every subset is equally likely."""

    def step(chosen, j):
        t = F.floor(rng.uniform(F.col("seed"), F.lit("draw"), j) * (j + 1)).cast("bigint")
        return F.concat(chosen, F.array(F.when(F.array_contains(chosen, t), j).otherwise(t)))

    return F.aggregate(
        F.when(n > 0, F.sequence((size - n).cast("bigint"), (size - 1).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>")),
        F.array().cast("array<bigint>"), step)


def sample_speakers(
    requests: DataFrame, pool: DataFrame, n_speakers: float, group: str = "gender"
) -> DataFrame:
    """Seeded sample without replacement from the request's group: request columns + speaker_id.

    A count draws that many indices per request and joins them to numbered
    candidates, so the work grows with the output and not with requests x pool.
    A proportion below 1 (at least one speaker) walks a seeded permutation of the
    indices, so each request emits exactly its own share, without pairs or a sort; ids
    up to a size are sent to every task, where a draw looks up its own.
    """
    ids = number_rows(pool.select("speaker_id", "ord", group), ["ord"], [group], out="_idx").drop("ord")
    sizes = ids.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    asked = requests.join(bounded_broadcast(sizes, F.lit(64), _SMALL), group)
    if n_speakers >= 1:
        drawn = asked.withColumn("_idx", F.explode(
            _draw_indices(F.least(F.col("_size"), F.lit(int(n_speakers))), F.col("_size"))))
        return drawn.join(ids, [group, "_idx"]).drop("_idx", "_size")
    wanted = F.greatest(F.floor(F.col("_size") * n_speakers), F.lit(1)).cast("bigint")
    asked = materialize(asked.withColumn("_n", wanted), "requests")
    # Indices come in blocks, so that no row ever holds a whole share.
    blocks = _dealt(asked, F.col("_n")).withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {_PIECE})")))
    if _bytes(ids, F.octet_length(F.col("speaker_id").cast("string")) + 16) <= _SMALL:
        return _looked_up(_numbered(blocks), ids, group, requests.columns)
    drawn = _numbered(blocks).withColumn("_j", F.explode(F.expr(
        f"sequence(_block * {_PIECE}, least(_n, (_block + 1) * {_PIECE}) - 1)")))
    permuted = F.pandas_udf(_permuted, "bigint")
    drawn = drawn.withColumn("_idx", permuted("_j", "_size", *[f"_n{c}" for c in "abcd"]))
    return drawn.drop("_n", "_block", "_j", *[f"_n{c}" for c in "abcd"]).join(ids, [group, "_idx"]).drop("_idx", "_size")


def _bytes(df: DataFrame, size: Column) -> int:
    """Bytes of a table, ``size`` for one row."""
    return df.agg(F.sum(size.cast("bigint")).alias("bytes")).first()["bytes"] or 0


def _dealt(asked: DataFrame, draws: Column) -> DataFrame:
    """Deal requests to as many tasks as keep about ``TASK_DRAWS`` draws in one, however small their table is."""
    total = asked.agg(F.sum(draws).alias("n")).first()["n"] or 0
    return asked.repartition(max(asked.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_DRAWS)))


def _collected(df: DataFrame, group: str, order: str) -> tuple[pa.Table, dict]:
    """A measured table sorted by group and ``order``, and the first row of each group."""
    table = df.orderBy(group, order).toArrow()
    groups = table.column(group).combine_chunks()
    if not len(groups):
        return table, {}
    runs = pc.run_end_encode(groups)
    ends = runs.run_ends.to_pylist()
    return table, dict(zip(runs.values.to_pylist(), [0, *ends[:-1]], strict=True))


def _looked_up(blocks: DataFrame, ids: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """The draws of blocks of requests, with the speakers' ids sent to every task: a draw is never shuffled."""
    table, starts = _collected(ids, group, "_idx")
    held = blocks.sparkSession.sparkContext.broadcast((table.column("speaker_id").combine_chunks(), starts))
    names = [group, *[c for c in columns if c != group]]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speakers, starts = held.value
        for batch in batches:
            n, block, *numbers = (batch.column(c).to_numpy() for c in ("_n", "_block", "_size", "_na", "_nb", "_nc", "_nd"))
            start = np.array([starts[g] for g in batch.column(group).to_pylist()], dtype=np.int64)
            first = block * _PIECE
            counts = np.minimum(n - first, _PIECE)
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):
                before = ends[at] - counts[at]
                stop = max(at + 1, int(np.searchsorted(ends, before + 2 * _PIECE, side="right")))
                who = np.repeat(np.arange(at, stop), counts[at:stop])
                j = np.arange(before, ends[stop - 1]) - (ends - counts - first)[who]
                place = _places(j, *[v[who] for v in numbers])
                rows = batch.select(names).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*rows.columns, speakers.take(pa.array(start[who] + place))], [*names, "speaker_id"])
                at = stop

    kinds = T.StructType([*[blocks.schema[c] for c in names], ids.schema["speaker_id"]])
    return blocks.mapInArrow(draw, kinds)


def _numbered(asked: DataFrame) -> DataFrame:
    """Add the four numbers ``_na`` .. ``_nd`` of each request's seeded permutation."""
    return asked.withColumns({f"_n{c}": F.floor(
        rng.uniform(F.col("seed"), F.lit("share"), F.lit(c)) * (1 << 30)).cast("bigint") for c in "abcd"})


def _mask(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, shift) of the least power of two that holds ``size`` places."""
    bits = np.maximum(np.frexp(np.maximum(size - 1, 1).astype(np.float64))[1], 1).astype(np.int64)
    return (np.int64(1) << bits) - 1, (bits + 1) // 2


def _walk(x: np.ndarray, size: np.ndarray, rounds: Callable) -> np.ndarray:
    """``rounds`` on all places, then again on those that are not below ``size``, until all are.

    The rounds permute, so a walk from below ``size`` always comes back there.
    """
    x = rounds(x, slice(None))
    out = np.flatnonzero(x >= size)
    while len(out):
        x[out] = rounds(x[out], out)
        out = out[x[out] >= size[out]]
    return x


def _permuted(j: pd.Series, size: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series(_places(*(col.to_numpy() for col in (j, size, a, b, c, d))))


def _places(j: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Place of ``j`` in a seeded permutation of 0..size-1.

    Two rounds of an odd multiplication and a shifted xor permute the next power of
    two; results beyond ``size`` go through the rounds again until they fit.
    """
    mask, half = _mask(size)

    def rounds(x, at):
        for factor, plus in ((a, b), (c, d)):
            x = (x * (factor[at] * 2 + 1) + plus[at]) & mask[at]
            x = x ^ (x >> half[at])
        return x

    return _walk(j, size, rounds)


def _inverse(factor: np.ndarray) -> np.ndarray:
    """Inverse of odd factors modulo 2**64 by Newton's steps, each of which doubles the right bits."""
    inv = factor.copy()
    for _ in range(5):
        inv = inv * (2 - factor * inv)
    return inv


def _turned(rows: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inverse factors and addends of the requests' rounds, in the order in which they are undone."""
    a, b, c, d = (rows[f"_n{x}"].to_numpy() for x in "abcd")
    return [(_inverse(c * 2 + 1), d), (_inverse(a * 2 + 1), b)]


def _drawn(back: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, size: int, idx: np.ndarray) -> np.ndarray:
    """Whether each request (row) draws each candidate (column) of a group of ``size``."""
    mask, half = (int(v[0]) for v in _mask(np.array([size])))

    def rounds(x, who):
        for inv, plus in back:
            x = x ^ (x >> half)
            x = ((x - plus[who]) * inv[who]) & mask
        return x

    x = rounds(idx[None, :], (slice(None), None))
    flat = x.reshape(-1)
    out = np.flatnonzero(flat >= size)
    while len(out):
        flat[out] = rounds(flat[out], out // len(idx))
        out = out[flat[out] >= size]
    return x < wanted[:, None]


def _shares(asked: DataFrame, known: DataFrame, share: float, group: str) -> DataFrame:
    """``asked`` and the sums of a seeded share of each request's group: _count, _females, _w, _wm, _ws, _vec, _ids in order.

    The same draw as ``sample_speakers``, turned round: a candidate is drawn if the inverse
    permutation puts its index below the wanted number. ``asked`` carries ``_req``, a number of its own.
    A pool up to a size is sent to every task, which sums a request as a whole, so that its ids,
    requests x share of the pool in all, stay where they are. Beyond it chunks and bundles are shuffled.
    """
    numbered = number_rows(known, ["ord"], [group], out="_idx").select(
        group, "_idx", "speaker_id", F.coalesce(F.col("gender") == "f", F.lit(False)).alias("_f"),
        *[F.col(c).cast("double").alias(c) for c in ("m", "s", "w")], "xvector")
    sizes = numbered.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    wanted = F.greatest(F.floor(F.col("_size") * share), F.lit(1)).cast("bigint")
    numbers = _numbered(asked.join(bounded_broadcast(sizes, F.lit(64), _SMALL), group)).withColumn("_n", wanted)
    if _bytes(numbered, F.size("xvector") * 8 + F.octet_length(F.col("speaker_id").cast("string")) + 64) <= POOL_LIMIT:
        return _whole_shares(materialize(numbers, "requests"), numbered, group, asked)
    parts = _chunked_shares(numbers, numbered, group).filter("_count > 0").join(asked, "_req")
    total = vector_to_array(Summarizer.sum(array_to_vector("_vec")))
    return parts.groupBy(*asked.columns).agg(
        *[F.sum(c).alias(c) for c in ("_count", "_females", "_w", "_wm", "_ws")], total.alias("_vec"),
        F.array_sort(F.flatten(F.collect_list("_ids"))).alias("_ids"))


def _facts(flags: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What is summed of each candidate: one, female, w, wm, ws and the vector."""
    return np.column_stack([np.ones(len(w)), flags.astype(np.float64), w, w * m, w * (s ** 2 + m ** 2), vectors])


def _whole_shares(numbers: DataFrame, numbered: DataFrame, group: str, asked: DataFrame) -> DataFrame:
    """``_shares`` with the pool in every task: slices of a batch's requests meet one chunk of candidates after another."""
    table, starts = _collected(numbered, group, "speaker_id")
    columns = {c: table.column(c).combine_chunks() for c in table.column_names}
    del table
    lengths = set(pc.list_value_length(columns["xvector"]).to_pylist()) or {0}
    if len(lengths) > 1 or None in lengths:
        raise ValueError("the pool's vectors must be of one length")
    vectors = columns["xvector"].flatten().to_numpy().reshape(-1, *lengths) if lengths != {0} else np.zeros((len(columns["_idx"]), 0))
    facts = _facts(*(columns[c].to_numpy(zero_copy_only=False) for c in ("_f", "w", "m", "s")), vectors)
    held = numbers.sparkSession.sparkContext.broadcast((columns["speaker_id"], columns["_idx"].to_numpy(), facts, starts))
    del columns, vectors, facts

    def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speakers, idx, facts, starts = held.value
        for batch in batches:
            rows = batch.select(["_size", "_n", "_na", "_nb", "_nc", "_nd"]).to_pandas()
            groups = batch.column(group).to_pylist()
            places = pd.Series(range(len(groups))).groupby(pd.Series(groups, dtype=object), sort=False).indices
            for value, place in places.items():
                size, first = int(rows["_size"].iloc[place[0]]), starts[value]
                step = max(1, min(64, (4 << 20) // size))
                for at in (place[i:i + step] for i in range(0, len(place), step)):
                    now = rows.iloc[at]
                    back, drawn, total = _turned(now), np.empty((len(at), size), dtype=bool), np.zeros((len(at), facts.shape[1]))
                    for i in range(0, size, CHUNK):
                        part = slice(first + i, first + min(i + CHUNK, size))
                        hit = _drawn(back, now["_n"].to_numpy(), size, idx[part])
                        drawn[:, i:i + CHUNK] = hit
                        total += hit.astype(np.float64) @ facts[part]
                    who, col = np.nonzero(drawn)
                    found = speakers.take(pa.array(first + col))
                    vec = lists(np.full(len(at), total.shape[1] - 5), pa.array(total[:, 5:].ravel()))
                    kept = batch.select(names).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*kept.columns, *[pa.array(total[:, i].copy()) for i in range(5)], vec, lists(np.bincount(who, minlength=len(at)), found)],
                        [*names, "_count", "_females", "_w", "_wm", "_ws", "_vec", "_ids"])

    names = asked.columns
    kinds = T.StructType([
        *asked.schema, *[T.StructField(c, T.DoubleType()) for c in ("_count", "_females", "_w", "_wm", "_ws")],
        T.StructField("_vec", T.ArrayType(T.DoubleType())), T.StructField("_ids", T.ArrayType(numbered.schema["speaker_id"].dataType))])
    return _dealt(numbers, F.col("_n")).mapInArrow(sums, kinds)


def _chunked_shares(numbers: DataFrame, numbered: DataFrame, group: str) -> DataFrame:
    """``_shares`` of a large pool, by request and chunk: chunks of candidates meet bundles of requests."""
    bundles = max(1, -(-numbers.count() // BUNDLE))
    left = numbers.select(
        F.struct(group).alias("_group"), F.pmod(F.xxhash64("_req"), F.lit(bundles)).alias("_bundle"),
        "_req", "_size", "_n", *[f"_n{c}" for c in "abcd"],
        F.explode(F.expr(f"sequence(0L, (_size - 1) div {CHUNK})")).alias("_chunk"))
    right = numbered.withColumn("_group", F.struct(group)).withColumn("_chunk", F.expr(f"_idx div {CHUNK}")).withColumn(
        "_bundle", F.explode(F.expr(f"sequence(0L, {bundles - 1}L)"))).drop(group)

    def sums(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(part):
            names = ("_req", "_count", "_females", "_w", "_wm", "_ws", "_vec", "_ids")
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        drawn = _drawn(_turned(rows), rows["_n"].to_numpy(), int(rows["_size"].iloc[0]), part["_idx"].to_numpy())
        facts = _facts(*(part[c].to_numpy() for c in ("_f", "w", "m", "s")), np.stack(part["xvector"].to_numpy()))
        total, ids = drawn.astype(np.float64) @ facts, part["speaker_id"].to_numpy()
        return pd.DataFrame({"_req": rows["_req"].to_numpy(), "_count": total[:, 0], "_females": total[:, 1], "_w": total[:, 2], "_wm": total[:, 3],
                             "_ws": total[:, 4], "_vec": list(total[:, 5:]), "_ids": [ids[row] for row in drawn]})

    kind = numbered.schema["speaker_id"].dataType.simpleString()
    keys = ["_group", "_chunk", "_bundle"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        sums, f"_req bigint, _count double, _females double, _w double, _wm double, _ws double, _vec array<double>, _ids array<{kind}>")


def average_xvector(selected: DataFrame, keys) -> DataFrame:
    """Mean vector of the selected speakers; partial sums combine map-side."""
    return selected.groupBy(*keys).agg(_mean_vector("xvector").alias("xvector"))


def majority_gender(selected: DataFrame, keys) -> DataFrame:
    """Gender of most selected speakers; a tie gives ``f``."""
    return selected.groupBy(*keys).agg(_majority().alias("gender"))


def _majority() -> Column:
    return F.when(F.count_if(F.col("gender") == "f") >= F.count_if(F.col("gender") == "m"), "f").otherwise("m")


def summarize_pitch(series: DataFrame) -> DataFrame:
    """Raw series to (m, s, w) of log F0 per speaker."""
    return series.filter(F.col("f0") != 0).groupBy("speaker_id").agg(
        F.avg(F.log("f0")).alias("m"), F.stddev_pop(F.log("f0")).alias("s"),
        F.count(F.lit(1)).alias("w"))


def _pooled() -> list[Column]:
    mean = F.sum(F.col("w") * F.col("m")) / F.sum("w")
    square = F.sum(F.col("w") * (F.col("s") ** 2 + F.col("m") ** 2)) / F.sum("w")
    return _spread(mean, square)


def _spread(mean: Column, square: Column) -> list[Column]:
    return [mean.alias("mean"), F.sqrt(F.greatest(square - mean ** 2, F.lit(0.0))).alias("std")]


def pool_pitch_stats(selected: DataFrame, keys) -> DataFrame:
    """Pooled mean and deviation of log F0 from (m, s, w) by the law of total variance."""
    return selected.groupBy(*keys).agg(*_pooled())


def raw_pitch_stats(series: DataFrame, keys) -> DataFrame:
    """Mean and population deviation of log F0 over all voiced values."""
    return series.filter(F.col("f0") != 0).groupBy(*keys).agg(
        F.avg(F.log("f0")).alias("mean"), F.stddev_pop(F.log("f0")).alias("std"))


def generate_pseudospeakers(
    requests: DataFrame, pool: DataFrame, pitch: DataFrame, n_speakers: float = 0.5,
    criterion: str | None = None, clusters: DataFrame | None = None, top_n: int = 10,
) -> DataFrame:
    """One pseudospeaker per request (seed, gender); a null or ``any`` gender is drawn.

    ``pool`` and ``pitch`` meet in an inner join, ``clusters`` carries the gender
    of its centre. All requests run in one job.
    """
    asked = requests.withColumn("gender", F.when(
        F.col("gender").isin(*GENDERS), F.col("gender")).otherwise(draw_gender(F.col("seed"))))
    known = materialize(pool.join(pitch, "speaker_id"), "pool")
    group = "gender" if criterion is None else "cluster"
    if criterion is not None:
        asked = choose_cluster(asked, clusters, criterion, top_n)
    if n_speakers < 1:
        # Equal requests draw alike: they are drawn once, and their speakers count as often as they were asked for.
        alike = [*requests.columns, *([] if criterion is None else [group])]
        asked = asked.groupBy(*alike).agg(F.count(F.lit(1)).cast("int").alias("_times"))
        asked = materialize(asked.withColumn("_req", F.monotonically_increasing_id()), "requests")
        again = F.flatten(F.transform("_ids", lambda x: F.array_repeat(x, F.col("_times"))))
        return _shares(asked, known, n_speakers, group).select(
            *[c for c in requests.columns if c != "gender"], F.col("gender").alias("asked_gender"),
            F.when(2 * F.col("_females") >= F.col("_count"), "f").otherwise("m").alias("gender"),
            F.transform("_vec", lambda x: x / F.col("_count")).alias("xvector"),
            *_spread(F.col("_wm") / F.col("_w"), F.col("_ws") / F.col("_w")),
            F.when(F.col("_times") > 1, again).otherwise(F.col("_ids")).alias("selected"))
    chosen = sample_speakers(asked, known, n_speakers, group)
    if criterion is not None:
        chosen = chosen.drop("cluster")
    facts = bounded_broadcast(known, F.size("xvector") * 8 + 128, POOL_LIMIT)
    chosen = chosen.withColumnRenamed("gender", "asked_gender").join(facts, "speaker_id")
    return chosen.groupBy(*[c for c in requests.columns if c != "gender"], "asked_gender").agg(
        _majority().alias("gender"), _mean_vector("xvector").alias("xvector"), *_pooled(),
        F.array_sort(F.collect_list("speaker_id")).alias("selected"))


def pseudospeaker_to_json(speakers: DataFrame) -> DataFrame:
    """One JSON text per pseudospeaker; selected ids are joined with ``:``."""
    payload = F.struct(
        "gender", "xvector", F.lit("float64").alias("xvector_dtype"),
        F.struct("mean", "std").alias("pitch_stats"),
        F.array_join(F.transform("selected", lambda x: x.cast("string")), ":").alias("selected_speakers"))
    return speakers.withColumn("json", F.to_json(payload))


def pseudospeaker_from_json(col: Column) -> Column:
    parsed = F.from_json(col, "gender string, xvector array<double>, xvector_dtype string, "
                              "pitch_stats struct<mean: double, std: double>, selected_speakers string")
    return parsed


def compare_strategies(a: DataFrame, b: DataFrame, keys=("seed", "asked_gender"), tol: float = 1e-8) -> DataFrame:
    """Per key, whether two strategies gave the same vector within ``tol``."""
    left = a.select(*keys, F.col("xvector").alias("_a"))
    right = b.select(*keys, F.col("xvector").alias("_b"))
    same = F.forall(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y) < tol), lambda ok: ok)
    return left.join(right, list(keys)).select(*keys, same.alias("same"))
