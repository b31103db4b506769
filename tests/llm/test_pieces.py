import random

import pytest

from helpers import ROWS, messy
from lineloom.llm import pieces as P
from lineloom.llm import queries


@pytest.fixture(scope="module")
def v():
    return P.load()


def best(v, word):
    """Plain Viterbi over one word."""
    score = dict(zip(v.pieces, v.scores))
    total = [0.0] + [-1e18] * len(word)
    for i in range(1, len(word) + 1):
        total[i] = total[i - 1] + v.fallback
        for j in range(max(0, i - 20), i):
            if word[j:i] in score:
                total[i] = max(total[i], total[j] + score[word[j:i]])
    return total[-1]


def value(v, ids):
    score = dict(zip(v.ids, v.scores))
    raw = b"".join(v.surface[i] for i in ids if i not in score)
    return sum(score.get(i, 0.0) for i in ids) + v.fallback * len(raw.decode())


def test_walk_is_as_good_as_plain_viterbi(v):
    rng = random.Random(5)
    words = {" " * rng.randrange(1, 4) + "".join(rng.choice("abcdethion é漢▁\n") for _ in range(rng.randrange(0, 25))) for _ in range(800)}
    words = sorted(words | {" the", " then", " thence", " the ", " aaaaaaaaaaaaaaaaaaaaaaaa"})
    for word, ids in zip(words, P.Encoder(v).walk(words)):
        assert b"".join(v.surface[i] for i in ids).decode() == word
        assert abs(value(v, ids) - best(v, word)) < 1e-6


def test_round_trip_of_messy_rows(spark, v):
    docs = messy(spark)
    back = P.decode(P.encode(docs, v), v)
    assert back.columns == docs.columns
    rows = back.collect()
    assert len(rows) == len(ROWS) and all(r.decoded == r.text for r in rows)
    assert [r.pieces for r in rows if r.text is None] == [None, None] and [r.pieces for r in rows if r.text == ""] == [[]]
    assert P.encode(docs.limit(0), v).count() == 0
    checked = P.encode_checked(docs, v)
    assert sorted(checked.columns) == sorted({*docs.columns, "round_trip"}) and P.encode_checked(docs.limit(0), v).count() == 0
    key = lambda r: (r.doc_id or 0, r.text or "", r.pieces or [])
    assert sorted(map(key, checked.collect())) == sorted(map(key, rows)) and all(r.round_trip for r in checked.collect())
    odd = spark.createDataFrame([([413, None, 99999999, -3, 0],), ([v.bytes_at[255]],), (None,), ([],)], "pieces array<int>")
    assert [r.decoded for r in P.decode(odd, v).collect()] == [v.surface[413].decode().lstrip(" "), "�", None, ""]


def test_slices_do_not_matter(spark, v):
    texts = ["a b", "", "  lead", "x", "a  b  ", "\n a"]
    one, many = P.Encoder(v), P.Encoder(v)
    import pyarrow as pa
    from lineloom.llm.words import slices
    whole = [x for _, _, d, at in slices(pa.array(texts)) for x in one.slice(d, at)[0].tolist()]
    parts = [x for _, _, d, at in slices(pa.array(texts), 1) for x in many.slice(d, at)[0].tolist()]
    assert whole == parts


def test_query_covers_every_text(spark):
    got = queries.op2_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.round_trip and r.n_pieces == len(r.pieces) for r in got)
