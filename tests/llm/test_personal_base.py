"""The base columns of op7's query against the plain patterns of its contract."""

import hashlib
import random
import re

import pytest

from nimbora.llm import personal_data, registry

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all((part.lstrip("0") or "0") in {str(n) for n in range(256)} for part in match.split("."))
    if kind == "card":
        doubled = "".join(str(int(d) * (1 + i % 2)) if int(d) * (1 + i % 2) < 10 else str(int(d) * 2 - 9) for i, d in enumerate(digits[::-1]))
        return 12 <= len(digits) <= 19 and sum(map(int, doubled)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [
        (m.start(), place, m.end())
        for place, (kind, pattern) in enumerate(PLAIN.items())
        for m in re.finditer(pattern, text)
        if passes(kind, m[0])
    ]
    return sorted(found)


TEXTS = [
    "mail ann.b+c@ex-am.ple.org, 10.0.0.255 256.1.1.1 1.2.3.4.5 4111 1111-1111 1111 +1 (650) 555-0100.",
    "0" * 5000 + ".1.1.1",
    "1.2.3." + "0" * 6000 + "7 and " + "9" * 5000 + ".1.1.1",
    "@@a@b.c..d@e.f@g.h", "+1" + " " * 400 + "23456789", "4" * 12 + " " + "0" * 19, "", None,
]


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    made = ["".join(rng.choices("0123456789..@+- a()é", k=rng.randint(0, 60))) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + made:
        assert personal_data.base_spans(text) == plain(text), text


def test_base_columns_of_the_query(spark, tmp_path):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choices([t or "x" for t in TEXTS[:1] + TEXTS[3:]], k=5)) for _ in range(40)]
    rows = [*enumerate(texts), (0, TEXTS[0]), (None, TEXTS[0])]
    spark.createDataFrame([(k, t, "k") for k, t in rows], "doc_id long, text string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in registry.QUERIES["op7_personal_data"](spark, str(tmp_path)).collect():
        got.setdefault((r["doc_id"], r["base_sha256"]), []).append(r)
    for key, text in rows:
        spans = plain(text or "")
        written = ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in spans)
        row = got[key, hashlib.sha256(written.encode()).hexdigest()].pop()
        counts = [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert [row[f"n_{kind}"] for kind in PLAIN] == counts
        assert set(filter(None, written.split(","))) <= set(row["spans"].split(","))
    assert not any(got.values())


@pytest.mark.parametrize("text", TEXTS)
def test_redaction_does_not_crash(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = personal_data.with_redaction(docs, personal_data.train(docs)).collect()
    assert (row["text"] is None) == (text is None)
