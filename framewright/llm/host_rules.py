"""Quality rules by host: rule failures of documents, pooled by host under a beta prior.

A document fails a rule on its own numbers (words, signs, repeated lines and windows).
Failure rates are counted by host and shrunk towards the corpus with a beta prior
fitted to the hosts' rates by moments. A host whose shrunk rate passes a rule's limit
fails as a whole, and its verdict comes back to its documents.

Defined cases: a null or empty text has no words and fails the base rule; a null host
is a host of its own; one host, or hosts of equal rates, get a prior of one
pseudo-document; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, add_columns, windows

WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
#: The signs that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Rules of a document and the shrunk failure rate from which a host fails.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "line_copies": "3 * n_dup_lines > n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)",
}
HOST_LIMIT = 0.5


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""

    def make():
        words = Words("solid", lower=False)
        b = np.arange(256)
        starts = (b < 128) | (b >= 192)  # the first byte of each code point
        symbol = np.isin(b, [ord(c) for c in SYMBOLS])

        def fn(rows, data, offsets):
            n = rows.num_rows
            doc, start, end, h = words.scan(data, offsets)
            points = np.concatenate([[0], np.cumsum(starts[data] & words.word[data], dtype=np.int64)])
            signs = np.concatenate([[0], np.cumsum(symbol[data], dtype=np.int64)])
            at, gram = windows(h, doc, WINDOW)
            key = gram ^ (doc[at].astype(np.uint64) << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key, kind="stable")
            same = np.zeros(len(key) + 1, bool)
            same[1:-1] = key[order][1:] == key[order][:-1]
            twice = at[order[same[1:] | same[:-1]]]
            covered = np.zeros(len(h) + 1, np.int64)
            np.add.at(covered, twice, 1)
            np.add.at(covered, twice + WINDOW, -1)
            repeated = np.cumsum(covered[:-1]) > 0
            raw, lines, copies = data.tobytes(), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i in range(n):
                if offsets[i] < offsets[i + 1]:
                    with_words = [x for x in raw[offsets[i] : offsets[i + 1]].split(b"\n") if x and not x.isspace()]
                    lines[i], copies[i] = len(with_words), len(with_words) - len(set(with_words))
            return {
                "n_words": np.bincount(doc, minlength=n), "word_chars": np.diff(points[offsets]), "n_symbols": np.diff(signs[offsets]),
                "n_lines": lines, "n_dup_lines": copies, "n_repeat_words": np.bincount(doc[repeated], minlength=n),
            }

        return fn

    return add_columns(docs, make, "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long", text, keep)


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """host, n and, per rule, the shrunk failure rate ``rate_<rule>``.

    The prior's strength is the moment estimate m(1-m)/v - 1 over the hosts' rates
    (each host counts once), between 1 and 1000 pseudo-documents.
    """
    per_host = measured.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.expr(rule)).alias(f"bad_{name}") for name, rule in RULES.items()])
    moments = [F.expr(f"sum(bad_{r}) / sum(n)").alias(f"m_{r}") for r in RULES] + [F.expr(f"var_pop(bad_{r} / n)").alias(f"v_{r}") for r in RULES]
    prior = per_host.agg(*moments).first()  # two numbers per rule
    rates = []
    for r in RULES:
        m, v = prior[f"m_{r}"] or 0.0, prior[f"v_{r}"] or 0.0
        strength = min(1000.0, max(1.0, m * (1 - m) / v - 1 if v > 0 else 1.0))
        rates.append(((F.col(f"bad_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{r}"))
    return per_host.select(host, "n", *rates)


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, the measures, ``base_failed``, ``host_failed`` and ``kept``."""
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", "kept"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in made]
    measured = materialize(measure(docs, text, list(dict.fromkeys([*names, host]))), "measures")
    bad = " or ".join(f"rate_{r} > {HOST_LIMIT}" for r in RULES)
    verdicts = host_rates(measured, host).select(F.col(host).alias("judged_host"), F.expr(f"coalesce({bad}, false)").alias("host_failed"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # Verdicts hold one row per host; the planner broadcasts them if they are small and splits hot hosts if not.
    return (measured.join(verdicts, measured[host].eqNullSafe(verdicts["judged_host"]), "left").withColumn("base_failed", base)
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False)))
            .select(*[measured[c] for c in names], *made))
