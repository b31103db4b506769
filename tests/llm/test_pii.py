import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lineloom.llm import pii, queries

TEXTS = [
    None, "", "write to ann.b-c+d@mail.example.com, or x@y", "a@b@c.de", "@x.y a@ b", "%@a.b..c.d", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8.9", "01.002.3.255.",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4041894974608795", "+1 (988) 555-2485 +12 +1((((((", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "iban GB82 WEST 1234 5698 7654 32 end", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "order 123-45-6789 version", "é@ü.de ä a.b@c.d 1.1.1.1",
    "9" * 3000, "a" * 3000 + "@" + "b" * 10, "a@b.c" * 200, "1." * 999,
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def base(text):
    """The stated patterns, straight from the regular expressions."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(digits(x)) <= 15),
    ]
    found = [(m.start(), k, kind, m.end()) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group())]
    return [f"{kind}:{s}:{e}" for s, _, kind, e in sorted(found)]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_equal_the_patterns(text):
    got = [f"{x['kind']}:{x['start']}:{x['end']}" for x in pii.spans(text) if x["kind"] in pii.BASE]
    assert got == base(text)


def test_checksums_and_context():
    kinds = lambda t: [x["kind"] for x in pii.spans(t)]
    assert kinds("iban GB82 WEST 1234 5698 7654 32 end") == ["iban"]
    assert "iban" not in kinds("iban GB82 WEST 1234 5698 7654 33 end")
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("order 123-45-6789 version") == []
    near, far = pii.spans("call +1 (988) 555-2485")[0]["score"], pii.spans("xx +1 (988) 555-2485")[0]["score"]
    assert near > far


def test_operator_and_query(spark, tmp_path):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(None, "a@b.c", None), (3, TEXTS[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = base("a@b.c" if r.doc_id is None else TEXTS[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k + ":") for w in want) for k in pii.BASE]
        assert set(want) <= set(filter(None, r.spans.split(",")))
    assert pii.find_pii(docs.limit(0)).count() == 0
    masked = {r.doc_id: r.text for r in pii.mask(docs.filter("doc_id in (0, 3, 9)")).collect()}
    assert masked[0] is None and masked[9] == "<card>" and masked[3] == "a@<email>"


def test_query_covers_whole_texts(spark, small_dir="/root/testdata/sf0.001"):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    want = {r.doc_id: ",".join(base(r.text)) for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r.base_sha256 for r in queries.op8_pii(spark, small_dir).select("doc_id", "base_sha256").collect()}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
    assert queries.op8_pii(spark, small_dir).agg(F.sum("n_card")).first()[0] is not None


def test_runs_of_digits_of_any_length():
    for n in (5_000, 100_000):
        assert [(x["kind"], x["start"], x["end"]) for x in pii.spans("0" * n + ".1.1.1")] == [("ip", 0, n + 6)]
        assert pii.spans("9" * n + ".1.1.1") == []
        assert pii.spans("1." + "0" * n + "256.1.1") == []
