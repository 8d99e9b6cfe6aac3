"""Whole workflows composed of the operators: work grid, anonymization, editing, release evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import rng
from framewright.operators import editing as E
from framewright.operators import evaluate as V
from framewright.operators import mixing as M
from framewright.operators import pool as P
from framewright.operators import segments as G
from framewright.operators import series as S
from framewright.operators.corpus import result_name, safe_stem
from framewright.operators.scans import BLOCK, attach, bounded_broadcast, with_totals
from framewright.session import materialize

VOICE_LIMIT = 256 << 20


def parse_list(text: str | None, kind: Callable = int, default: Sequence = ()) -> list:
    """Comma-separated values; blank entries are skipped, an empty text gives the default."""
    items = [part.strip() for part in (text or "").split(",")]
    return [kind(p) for p in items if p] or list(default)


def work_grid(utts: DataFrame, seeds: Sequence[int], ratios: Sequence[float], gender: str | None = None,
              speaker_mode: str = "pseudo", include_original: bool = False, base_seed: int = 0) -> DataFrame:
    """One row per recording, seed and ratio: utt_id, path, speaker_mode, seed, gender, ratio, result.

    Without seeds the pseudo mode draws one per recording from ``base_seed``; the
    original mode (or ``include_original``) adds rows with the recording's own voice.
    """
    ratio = F.explode(F.array(*[F.lit(float(r)) for r in ratios])).alias("ratio")
    wanted = gender if gender in P.GENDERS else None
    parts = []
    if speaker_mode == "pseudo":
        if seeds:
            seeded = utts.select("utt_id", "path", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
        else:
            seeded = utts.select("utt_id", "path", F.floor(
                rng.uniform(base_seed, F.col("path"), "seed") * 1_000_000).cast("int").alias("seed"))
        rows = seeded.select("*", ratio).withColumn("gender", F.lit(wanted).cast("string"))
        parts.append(rows.select(
            "utt_id", "path", F.lit("pseudo").alias("speaker_mode"), F.col("seed").cast("bigint").alias("seed"), "gender",
            "ratio", result_name(F.col("path"), F.col("ratio"), F.col("seed"), F.col("gender")).alias("result")))
    if speaker_mode == "original" or include_original:
        share = F.replace(F.format_string("adm%.3f", F.col("ratio")), F.lit("."), F.lit("p"))
        rows = utts.select("utt_id", "path", ratio)
        parts.append(rows.select(
            "utt_id", "path", F.lit("original").alias("speaker_mode"), F.lit(None).cast("bigint").alias("seed"),
            F.lit(None).cast("string").alias("gender"), "ratio",
            F.concat_ws("_", F.lit("anonymized"), safe_stem(F.col("path")), F.lit("original"), share).alias("result")))
    grid = parts[0]
    for part in parts[1:]:
        grid = grid.unionByName(part)
    return grid


def pending_work(grid: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid rows still to do, and status rows (``skipped``) of those with a non-empty result.

    ``results``: result, n_bytes. Done before any frame is read.
    """
    done = results.filter("n_bytes > 0").select("result").distinct()
    todo = grid.join(done, "result", "left_anti")
    skipped = grid.join(done, "result", "left_semi").select(
        "utt_id", "result", F.lit("skipped").alias("status"), F.lit(None).cast("int").alias("sample_rate"))
    return todo, skipped


def anonymize(
    f0: DataFrame, orig: DataFrame, syn: DataFrame, pool: DataFrame, pitch: DataFrame, grid: DataFrame,
    own_vectors: DataFrame | None = None, n_speakers: float = 2, criterion: str | None = None,
    clusters: DataFrame | None = None, gate: bool = True, tau: float = M.GATE, pitch_share: float = 0.75,
    noise: float = 0.0, block: int = BLOCK, spoken_by: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Frames (utt_id, result, frame, f0, vec) and speakers (utt_id, result, gender, xvector) of every grid row.

    With ``spoken_by`` the frames carry their speaker's xvector; frames without a speaker are left out then.

    Every part works at its own grain: log statistics and the comparison of the
    streams per recording, pitch and noise per recording and voice. The settings
    meet a frame last, as an array of its recording, so that a vector is moved
    once and not once per setting. Rows in original mode keep the pitch and need
    ``own_vectors`` (utt_id, xvector).
    """
    asked = grid.filter("speaker_mode = 'pseudo'").select(
        "seed", F.coalesce("gender", F.lit("any")).alias("gender")).distinct().withColumn("asked", F.col("gender"))
    speakers = P.generate_pseudospeakers(asked, pool, pitch, n_speakers, criterion, clusters)
    # One row per (seed, gender), used by every part below.
    voices = materialize(speakers.select(
        "seed", F.col("asked").alias("_g"), F.col("gender").alias("voice"), "mean", "std", "xvector"), "voices")
    numbers = bounded_broadcast(voices.select("seed", "_g", "mean", "std"), F.lit(128), VOICE_LIMIT)
    settings = grid.withColumn("_g", F.coalesce("gender", F.lit("any"))).join(
        numbers, ["seed", "_g"], "left").select("utt_id", "result", "speaker_mode", "seed", "_g", "ratio", "mean", "std")
    keys = ["utt_id", "result"]

    # Pitch, per recording and voice.
    voice = ["utt_id", "seed", "_g"]
    log_f0 = F.when(F.col("f0") != 0, F.log("f0"))
    own = with_totals(f0.select("utt_id", "frame", "f0"), "utt_id",
                      [F.avg(log_f0).alias("_m"), F.stddev_pop(log_f0).alias("_s")], block=block)
    wanted = settings.filter("speaker_mode = 'pseudo'").select(*voice, "mean", "std").distinct()
    tuned = attach(own, wanted, "utt_id", block=block).withColumn(
        "f0", S.moved_pitch(F.col("f0"), F.col("_m"), F.col("_s"), F.col("mean"), F.col("std")))
    tuned = materialize(tuned.select(*voice, "frame", "f0"), "voiced-pitch")
    tuned = S.add_noise(S.smooth_voiced(tuned, 32, pitch_share, voice, block), noise, F.col("seed"), voice, block=block)
    # A frame's variants stand in the order of its recording's voices, so a setting finds its own by number.
    variants = tuned.groupBy("utt_id", "frame").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seed", "_g", "f0"))), lambda v: v["f0"]).alias("_variants"))
    numbered = wanted.groupBy("utt_id").agg(F.array_sort(F.collect_set(F.struct("seed", "_g"))).alias("_voices")).select(
        "utt_id", F.posexplode("_voices").alias("_voice", "_who")).select("utt_id", "_voice", "_who.*")
    voiced = settings.join(numbered, voice, "left")  # none in original mode

    # Everything about a frame but its vectors, then one join with the streams.
    per_utt = voiced.groupBy("utt_id").agg(
        F.collect_list(F.struct("result", "speaker_mode", "seed", "_g", "_voice", "ratio")).alias("_settings"))
    carried = []
    if spoken_by and own_vectors is not None:
        per_utt, carried = per_utt.join(own_vectors.select("utt_id", F.struct("xvector").alias("_own")), "utt_id", "left"), ["_own"]
    narrow = attach(f0.select("utt_id", "frame", "f0"), per_utt, "utt_id", block=block).join(
        variants, ["utt_id", "frame"], "left")
    both = orig.select("utt_id", "frame", "vec").join(
        syn.select("utt_id", "frame", F.col("vec").alias("_syn")), ["utt_id", "frame"])
    reject = F.lit(False)
    if gate:
        both = both.join(M.windowed_corr(syn, orig), ["utt_id", "frame"])
        reject = F.col("corr") < tau
    placed = both.withColumn("_rejected", reject).join(narrow, ["utt_id", "frame"]).select(
        "utt_id", "frame", "f0", "vec", "_syn", "_rejected", "_variants", *carried, F.explode("_settings").alias("_a"))
    keep = (rng.uniform(F.coalesce(F.col("_a.seed"), F.lit(0)), F.col("utt_id"), F.col("frame")) > F.col("_a.ratio")) | F.col("_rejected")
    spoken = F.get("_variants", F.col("_a._voice"))
    original = F.col("_a.speaker_mode") == "original"
    frames = placed.select(
        "utt_id", F.col("_a.result").alias("result"), "frame",
        F.when(original, F.col("f0")).otherwise(spoken).alias("f0"),
        F.when(keep, F.col("vec")).otherwise(F.col("_syn")).alias("vec"),
        *([original.alias("_original"), "_a.seed", "_a._g", *carried] if spoken_by else []))

    faces = voices.select("seed", "_g", "voice", "xvector")
    looks = bounded_broadcast(faces, F.size("xvector") * 8 + 128, VOICE_LIMIT)
    table = settings.filter("speaker_mode = 'pseudo'").join(looks, ["seed", "_g"]).select(
        *keys, F.col("voice").alias("gender"), "xvector")
    if own_vectors is not None:
        own = settings.filter("speaker_mode = 'original'").select(*keys).join(own_vectors, "utt_id")
        table = table.unionByName(own.select(*keys, F.lit(None).cast("string").alias("gender"), "xvector"))
    if spoken_by and looks is faces:  # too many voices for every task
        frames = attach(frames.drop("_original", "seed", "_g", *carried), table.select(*keys, "xvector"), keys, block=block)
    elif spoken_by:
        # The own vector came with the recording and the voices are sent to every task: the frames of a setting do not move.
        frames = frames.join(looks.select("seed", "_g", F.struct("xvector").alias("_look")), ["seed", "_g"], "left")
        face = F.when(F.col("_original"), F.col("_own") if carried else F.lit(None)).otherwise(F.col("_look"))
        frames = frames.withColumn("_face", face).filter("_face is not null").select(*keys, "frame", "f0", "vec", F.col("_face.xvector").alias("xvector"))
    return frames, table


def anonymize_recordings(
    raw_pitch: DataFrame, codes: DataFrame, generated: DataFrame, ranges: DataFrame, codebook: DataFrame, levels: int,
    pool: DataFrame, pitch: DataFrame, grid: DataFrame, own_vectors: DataFrame | None = None, block: int = BLOCK, **options,
) -> tuple[DataFrame, DataFrame]:
    """From extracted features to model input: (utt_id, result, frame, input) and the speakers of ``anonymize``.

    The pitch is resampled to the codes' length, generated pieces (utt_id, seg, i,
    codes) overlay their ranges (utt_id, seg, f0, f1), damaged code columns are
    taken from the original, both streams are decoded and mixed, and every frame
    becomes ``[vec ; f0 ; speaker vector]``. ``options`` go to ``anonymize``.
    """
    lengths = codes.groupBy("utt_id").agg(F.count(F.lit(1)).alias("_codes"))
    placed = attach(raw_pitch.select("utt_id", "frame", "f0"), lengths, "utt_id", block=block)
    f0 = materialize(S.resample_linear(placed, F.col("_codes"), block=block), "resampled-pitch")
    spoken = G.overlay_segments(codes, generated, ranges, "codes")
    spoken = M.repair_columns(spoken, codes, levels, block=block)
    orig, syn = (M.rvq_decode(x, codebook, levels).filter("vec is not null").select("utt_id", "frame", "vec") for x in (codes, spoken))
    frames, speakers = anonymize(f0, orig, syn, pool, pitch, grid, own_vectors, block=block, spoken_by=True, **options)
    return frames.select("utt_id", "result", "frame", F.concat("vec", F.array("f0"), "xvector").alias("input")), speakers


def edit(base: DataFrame, words: DataFrame, picked: DataFrame, texts: DataFrame, repl: DataFrame,
         k: int = E.GRAFT, match_pitch: bool = True) -> tuple[DataFrame, DataFrame]:
    """Replace groups of picked words in many recordings: edited frames, and error rows.

    ``picked``: utt_id, word_idx. ``texts``: utt_id, k, text. ``repl``: utt_id,
    op (= group number), frame, f0, vec of the generated pieces. Pieces take the
    log-pitch statistics of their recording; recordings whose text and group
    counts differ stay unedited and are reported.
    """
    groups = E.group_consecutive(picked)
    paired = materialize(E.pair_replacements(groups, texts), "edit-groups")
    errors = paired.filter("error is not null").select("utt_id", "error")
    spans = E.group_spans(paired.filter("error is null").select("utt_id", "group_no", "first", "last", "text"), words)
    ops = materialize(spans.select("utt_id", F.col("group_no").alias("op"), "start_frame", "end_frame"), "edit-spans")
    pieces = repl.join(ops.select("utt_id", "op"), ["utt_id", "op"], "left_semi")
    if match_pitch:  # its statistics and blocks read the pieces several times
        pieces = materialize(pieces, "edit-pieces")

    def convert(piece):
        log_f0 = F.when(F.col("f0") != 0, F.log("f0"))
        stats = base.groupBy("utt_id").agg(F.avg(log_f0).alias("_rm"), F.stddev_pop(log_f0).alias("_rs"))
        rows = attach(piece, stats, "utt_id")
        return S.convert_pitch(rows, F.col("_rm"), F.col("_rs"), ["utt_id", "op"]).drop("_rm", "_rs")

    return E.apply_splices(base, ops, pieces, k, convert if match_pitch else None), errors


def evaluate_release(timings: DataFrame, similarities: DataFrame, wers: DataFrame, rules: DataFrame,
                     prices: Mapping[str, float] | None = None, total: str = "TOTAL") -> dict[str, DataFrame]:
    """Tables of a release report: checks, totals, timing, audio and (with prices) cost.

    ``similarities``: setting, similarity. ``wers``: setting, wer, edits, n_ref.
    """
    sims = similarities.groupBy("setting").agg(F.avg("similarity").alias("mean_sim"), F.min("similarity").alias("min_sim"))
    rates = V.wer_summary(wers, ["setting"]).select("setting", "mean_wer", "corpus_wer")
    wide = sims.join(rates, "setting", "full")
    names = ["mean_sim", "min_sim", "mean_wer", "corpus_wer"]
    metrics = wide.select(
        F.concat(F.lit("operating point "), F.col("setting")).alias("check"),
        F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("metric", "value"))
    checks = V.evaluate_checks(metrics, rules)
    out = {"checks": checks, "totals": V.status_totals(checks), "timing": V.timing_table(timings),
           "audio": V.audio_summary(timings)}
    if prices:
        out["cost"] = V.cost_table(timings, prices, total=total)
    return out
