import math
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import messy
from pyspark.sql import functions as F

from lineloom.llm import perplexity as P
from lineloom.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", "ab ab ab ab", "x y z\nx y z\n\n \nx y z", "the cat sat on the mat. the cat sat!", "ünï 漢字 漢字 漢字\r\n#*$ %&|<>", "\x00nul \x02\x03 marks", "  lead\ttail  ",
         "one two three four " * 20, "z" * 400, None, None, "the cat sat on the mat. the cat sat!", "ab cd \U0001f600\U0001f600"]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


class Brute:
    """Modified Kneser-Ney by dictionaries."""

    def __init__(self, texts):
        self.counts = [Counter() for _ in range(6)]
        for t in texts:
            for g in self.grams(t):
                self.counts[5][g] += 1
        for k in (4, 3, 2, 1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.disc, self.total, self.free = {}, defaultdict(int), defaultdict(float)
        for k in range(1, 6):
            n = [sum(c == i for c in self.counts[k].values()) for i in (1, 2, 3, 4)]
            self.disc[k] = P.discounts(n)
            for g, c in self.counts[k].items():
                self.total[g[:-1]] += c
                self.free[g[:-1]] += self.disc[k][min(c, 3) - 1]

    @staticmethod
    def grams(text):
        s = "\x02" * 4 + " ".join(WORD.findall((text or "").replace("\x00", "�"))) + "\x03"
        return [s[i : i + 5] for i in range(len(s) - 4)]

    def p(self, g):
        k, c = len(g), self.counts[len(g)][g]
        if not self.total[g[:-1]]:
            return self.p(g[1:])
        shorter = self.p(g[1:]) if k > 1 else 1 / (len(self.counts[1]) + 1)
        return (c - self.disc[k][min(c, 3) - 1] if c else 0) / self.total[g[:-1]] + self.free[g[:-1]] / self.total[g[:-1]] * shorter

    def figure(self, text):
        grams = self.grams(text)
        return -sum(math.log10(self.p(g)) for g in grams) / len(grams)


def prose(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "cat", "and", "dog", "ran", "über", "sat", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_measures_and_perplexity_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    texts = TEXTS + prose(1, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(5)
    model = P.fit(docs)
    brute = Brute(texts)
    got = P.score(docs, model, model.counts).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[m] for m in P.MEASURES) == base(texts[r.n]), texts[r.n]
        assert r.log10_perplexity == pytest.approx(brute.figure(texts[r.n]), rel=1e-9)


def test_texts_that_the_model_has_not_seen(spark):
    seen, new = prose(2, 40), prose(3, 20) + ["never? seen~ 漢字", "", None]
    model = P.fit(spark.createDataFrame([(t,) for t in seen], "text string"))
    brute = Brute(seen)
    for r in P.score(spark.createDataFrame(list(enumerate(new)), "n int, text string"), model).collect():
        assert r.log10_perplexity == pytest.approx(brute.figure(new[r.n]), rel=1e-9)


def test_probabilities_add_up_to_one():
    brute = Brute(prose(4, 30))
    for context in ("the ", "\x02\x02\x02\x02", "zzzz"):
        known = sum(brute.p(context + c) for c in brute.counts[1])
        assert known < 1 and known + brute.p(context + "~") == pytest.approx(1)


def test_bands_by_language(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["a", "b", None]), round(rng.gauss(1, 0.1), 3)) for k in range(3000)] + [(9000, "lone", 0.5)]
    got = {r.lang: (r.low, r.high) for r in P.bands(spark.createDataFrame(rows, "n int, lang string, log10_perplexity double"), "lang").collect()}
    for lang in ("a", "b", None, "lone"):
        bins = sorted(math.floor(x * 1000) for _, of, x in rows if of == lang)
        low, high = (bins[math.ceil(len(bins) * q) - 1] / 1000 for q in (0.25, 0.75))
        spread = max(high - low, 0.01) * P.WIDTH
        assert got[lang] == pytest.approx((low - spread, high + spread))


def test_query_on_messy_rows(spark, tmp_path):
    rows = [(100 + k, t, lang, "s", 1) for k, t in enumerate(prose(5, 50)) for lang in ("en", None)]
    rows += [(900, "q9#Z~ " * 3 + "".join(chr(33 + (k * 37) % 90) + (" " if k % 5 == 0 else "") for k in range(600)), "en", "s", 1)] + [(901, "same words again " * 40, "en", "s", 1)] * 2
    df = messy(spark).unionByName(messy(spark, rows))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op12_perplexity_bands(spark, str(tmp_path)).collect()
    assert len(got) == df.count()
    text = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[m] for m in P.MEASURES) == base(text[r.doc_id])
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[900] and not kept[901] and sum(r.kept for r in got) > 20
    judged = P.judge(df)
    assert "text" not in judged.columns and {"source", "score", "label"} <= set(judged.columns)


def test_empty_table_and_long_word(spark):
    none = spark.createDataFrame([], "doc_id int, text string, lang string")
    assert P.judge(none).collect() == []
    long = spark.createDataFrame([(1, "x" * 3_000_000, "en"), (2, "y " * 60, "en")], "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in P.judge(long).collect()}
    assert got[1].word_chars == 3_000_000 and got[1].base_failed and got[2].n_repeat_words == 60
