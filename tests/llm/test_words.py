import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm.words import Words, sliced, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abAB 1.\n\tÄé漢🙂", max_size=30)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.sampled_from(["alnum", "solid"]), st.integers(1, 60))
def test_words_equal_the_pattern(texts, spec, limit):
    pattern = {"alnum": rb"[0-9A-Za-z\x80-\xff]+", "solid": rb"[^\x20\x09-\x0D]+"}[spec]
    words, found, names = Words(spec), [], {}
    batch = pa.record_batch([pa.array(texts, pa.string())], ["t"])
    for rows, data, offsets in sliced(batch, "t", limit):
        doc, start, end, h = words.scan(data, offsets)
        raw, own = data.tobytes(), [[] for _ in range(rows.num_rows)]
        for d, s, e, x in zip(doc, start, end, h, strict=True):
            own[d].append(raw[s:e])
            assert names.setdefault(int(x), raw[s:e].lower()) == raw[s:e].lower()
        found += own
    assert found == [re.findall(pattern, (t or "").encode()) for t in texts]
    assert len(set(names.values())) == len(names)


def test_windows_stay_inside_documents():
    doc = np.array([0, 0, 0, 1, 1, 2])
    at, h = windows(np.array([5, 6, 5, 6, 5, 6], np.uint64), doc, 2)
    assert at.tolist() == [0, 1, 3] and h[1] == h[2] != h[0]
    assert len(windows(np.array([1], np.uint64), np.array([0]), 3)[0]) == 0
