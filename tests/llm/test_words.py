import re

import numpy as np
import pyarrow as pa
import pytest

from lineloom.llm.words import NOT_ALNUM, grams, prefix_hashes, slices, span_hash, words

TEXTS = ["", None, "a", "  A b\tB\n\nccc  ", "Ünï cödé wörd", "x" * 5000, " ", "one two three four", "\x0b\x0c\rend", "one TWO three"]


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))


@pytest.mark.parametrize("size", [1, 16, 1 << 20])
def test_words_equal_the_pattern(size):
    names, seen = {}, 0
    for i, j, data, at in slices(pa.array(TEXTS), size):
        w = words(data, at)
        for r in range(j - i):
            own = np.flatnonzero(w.row == r)
            got = [bytes(data[w.start[k] : w.end[k]]).decode() for k in own]
            assert [x.translate({k: k + 32 for k in range(65, 91)}) for x in got] == plain(TEXTS[i + r])
            for k, x in zip(own, plain(TEXTS[i + r])):
                assert names.setdefault(x, w.hash[k]) == w.hash[k]
            seen += 1
    assert seen == len(TEXTS) and len(set(names.values())) == len(names)


def test_grams_are_equal_just_when_words_are():
    data = [t for t in TEXTS if t is not None] + ["two three four one", "three"]
    (_, _, raw, at), = slices(pa.array(data))
    row, h = grams(words(raw, at), 3)
    want = []
    for r, t in enumerate(data):
        w = plain(t)
        want += [(r, tuple(w))] if 0 < len(w) < 3 else [(r, tuple(w[i : i + 3])) for i in range(len(w) - 2)]
    assert row.tolist() == [r for r, _ in want]
    assert len({x: v for (_, x), v in zip(want, h)}) == len({x for _, x in want}) == len(set(h.tolist()))


def test_spans_hash_alike_anywhere():
    codes = np.array([5, 6, 7, 9, 5, 6, 7, 1])
    sums = prefix_hashes(codes)
    h = span_hash(sums, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]


def test_punctuation_may_separate():
    (_, _, raw, at), = slices(pa.array(["a,b. (c)-d é!"]))
    w = words(raw, at, NOT_ALNUM)
    assert len(w.hash) == 5
