"""Benchmark decontamination: a generalised suffix automaton of the test items.

Items and documents become words (A-Z lower-cased, ASCII letters and digits and all
bytes from 0x80). The automaton holds every run of item words; each document streams
through it and keeps the longest match that ends at each word. A match of at least
``window`` words, or of a whole item that is shorter, hits its words.

Defined cases: a null or empty text has no words, no hits and no items; an item without
words matches nothing; an item without an id hits words but is not listed; items that
share an id count once; an empty benchmark hits nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .words import Words, add_columns

WINDOW, COVERAGE = 13, 20
#: Item words in one automaton (about 300 bytes each in a worker); more items take more passes.
PASS_WORDS = 400_000


class SuffixAutomaton:
    """Generalised suffix automaton over lists of word numbers."""

    def __init__(self, items: list[list[int]], window: int):
        self.go, self.link, self.length, self.window = [{}], [-1], [0], window
        ends: dict[int, set[int]] = {}
        whole: dict[int, set[int]] = {}
        for number, words in enumerate(items):
            at = 0
            for word in words:
                at = self._extend(at, word)
                ends.setdefault(at, set()).add(number)
            if words and len(words) < window:
                whole.setdefault(at, set()).add(number)
        # A state's items are those of all states below it in the suffix tree.
        order = sorted(range(1, len(self.go)), key=lambda s: -self.length[s])
        for s in order:
            if s in ends and self.link[s] > 0:
                ends.setdefault(self.link[s], set()).update(ends[s])
        self.items = {s: frozenset(found) for s, found in ends.items()}
        # Short items that end at a state: its own and those of its suffixes.
        self.short: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for s in reversed(order):
            own = [(len(items[min(whole[s])]), frozenset(whole[s]))] if s in whole else []
            if own or self.link[s] in self.short:
                self.short[s] = self.short.get(self.link[s], []) + own

    def _state(self, length: int) -> int:
        self.go.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.go) - 1

    def _split(self, last: int, word: int, target: int) -> int:
        copy = self._state(self.length[last] + 1)
        self.go[copy] = dict(self.go[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while last >= 0 and self.go[last].get(word) == target:
            self.go[last][word] = copy
            last = self.link[last]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.go[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1)
        while last >= 0 and word not in self.go[last]:
            self.go[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.go[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new

    def hits(self, words: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Mark hit words of one run and collect the numbers of the items whose windows occur."""
        state, matched, go, link, length, window = 0, 0, self.go, self.link, self.length, self.window
        for i, word in enumerate(words):
            while state and word not in go[state]:
                state = link[state]
                matched = length[state]
            state = go[state].get(word, 0)
            matched = matched + 1 if state else 0
            for size, owners in self.short.get(state, ()):
                if size <= matched:
                    hit[i + 1 - size : i + 1] = True
                    found |= owners
            if matched >= window:
                hit[i + 1 - window : i + 1] = True
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found |= self.items[at]


def item_words(items: DataFrame, id_col: str = "item_id", text: str = "text") -> list[list[tuple[str | None, list[int]]]]:
    """(id, word hashes) of the items that have words, in groups of about PASS_WORDS words."""
    words = Words("alnum")
    groups: list[list] = [[]]
    filled = 0
    for row in items.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("body")).filter("body is not null").toLocalIterator():
        raw = np.frombuffer(row["body"].encode(), np.uint8)
        own = words.scan(raw, np.array([0, len(raw)]))[3].tolist()
        if groups[-1] and filled + len(own) > PASS_WORDS:
            groups.append([])
            filled = 0
        if own:
            groups[-1].append((row["id"], own))
            filled += len(own)
    return groups


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: int = COVERAGE, text: str = "text",
                       keep: list[str] | None = None, cut: bool = False, prefix: str = "") -> DataFrame:
    """The kept columns and n_words, n_hit, n_items, items_sha256, contaminated (after ``prefix``).

    ``contaminated``: some word is hit and ``coverage * n_hit >= n_words``. With
    ``cut`` the text comes back without its hit spans. Items beyond one automaton's
    bound take a pass over the documents for each group.
    """
    spark = docs.sparkSession
    names, out = list(docs.columns if keep is None else keep), docs
    groups = item_words(items)
    for k, group in enumerate(groups):
        held, last = spark.sparkContext.broadcast(group), k == len(groups) - 1
        carried = [f"_hit_words{k - 1}", f"_hit_items{k - 1}", *names] if k else names
        fields = ", ".join(prefix + f for f in ("n_words long", "n_hit long", "n_items long", "items_sha256 string", "contaminated boolean")) if last else f"_hit_words{k} binary, _hit_items{k} array<string>"
        if last and cut:
            fields += f", `{text}` string"

        def make(held=held, last=last, seen=k > 0, k=k):
            words, ids = Words("alnum"), [i for i, _ in held.value]
            vocabulary = np.unique(np.array([w for _, own in held.value for w in own], np.uint64))
            automaton = SuffixAutomaton([np.searchsorted(vocabulary, np.array(own, np.uint64)).tolist() for _, own in held.value], window)
            least = min([window, *(len(own) for _, own in held.value)])

            def fn(rows, data, offsets):
                doc, start, end, h = words.scan(data, offsets)
                many = np.bincount(doc, minlength=rows.num_rows)
                first = np.concatenate([[0], np.cumsum(many)])
                hit, found = np.zeros(len(h), bool), [set() for _ in range(rows.num_rows)]
                if seen:
                    for i, (old, listed) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                        hit[first[i] + np.frombuffer(old, "<i4")] = True
                        found[i].update(listed)
                if len(vocabulary):
                    number = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    known = vocabulary[number] == h
                    edge = np.ones(len(h) + 1, bool)
                    edge[1:-1] = ~known[1:] | ~known[:-1] | (doc[1:] != doc[:-1])
                    cuts = np.flatnonzero(edge)
                    runs = np.flatnonzero(known[cuts[:-1]] & (np.diff(cuts) >= least)) if len(h) else []
                    for r in runs:
                        a, b = cuts[r], cuts[r + 1]
                        names_found: set[int] = set()
                        automaton.hits(number[a:b].tolist(), hit[a:b], names_found)
                        found[doc[a]].update(ids[n] for n in names_found if ids[n] is not None)
                n_hit = np.bincount(doc[hit], minlength=rows.num_rows)
                if not last:
                    return {f"_hit_words{k}": [np.flatnonzero(hit[first[i] : first[i + 1]]).astype("<i4").tobytes() for i in range(rows.num_rows)],
                            f"_hit_items{k}": [sorted(f) for f in found]}
                made = {"n_words": many, "n_hit": n_hit, "n_items": [len(f) for f in found],
                        "items_sha256": [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found],
                        "contaminated": (n_hit > 0) & (coverage * n_hit >= many)}
                made = {prefix + name: values for name, values in made.items()}
                if cut:
                    made[text] = [_without(data[offsets[i] : offsets[i + 1]], start[s] - offsets[i], end[s] - offsets[i], hit[s]).decode("utf-8", "replace")
                                  for i, s in enumerate(slice(first[j], first[j + 1]) for j in range(rows.num_rows))]
                return made

            return fn

        out = add_columns(out, make, fields, text, carried + ([text] if not last and text not in carried else []))
        if not last:
            out = materialize(out, "decontamination-pass")
    return out.drop(f"_hit_words{len(groups) - 2}", f"_hit_items{len(groups) - 2}")


def _without(raw: np.ndarray, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """A text's bytes without its runs of hit words (from a run's first to its last byte)."""
    stay = np.ones(len(raw), bool)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2):
        stay[start[a] : end[b - 1]] = False
    return raw[stay].tobytes()
