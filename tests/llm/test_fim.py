import hashlib
import re

import pytest

from millrace.llm import fim

SCHEMA = "doc_id long, text string"


def plainly(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", text, None, None
    if h[3] % 100 < 50:
        return len(units), "spm", f"<S>{suffix}<P>{prefix}<M>{middle}", len(prefix), len(middle)
    return len(units), "psm", f"<P>{prefix}<S>{suffix}<M>{middle}", len(prefix), len(middle)


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_document_against_plain_code(documents):
    rows = fim.fill_in_middle(documents).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {i: plainly(i, t) for i, t in texts.items()}
    digests = fim.digest(fim.fill_in_middle(documents)).collect()
    assert all(r["restored_sha256"] == hashed(texts[r["doc_id"]] or "") for r in digests)
    assert {r["form"] for r in digests} >= {"psm", "spm"}


ODD = [
    (1, None),
    (2, ""),
    (None, "a\nb"),
    (3, "\n"),
    (3, "\n"),
    (4, "x<P>y\nz"),
    (5, "<\nS>\n<P\n>\nM>"),
    (6, "é\r\n😀\n\n\x00tail"),
    (7, "line\n" * 200_000),
    (8, "w" * 2_000_000),
    (9, "a<\n<S\nP>"),
]


def test_odd_texts(spark):
    frame = spark.createDataFrame([(*row, "x", "y") for row in ODD], f"{SCHEMA}, cut string, form string")
    found = fim.fill_in_middle(frame)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(i, *plainly(i, t)) for i, t in ODD], key=repr)
    rebuilt = sorted(r["restored_sha256"] for r in fim.digest(found).collect())
    assert rebuilt == sorted(hashed(t or "") for _, t in ODD)
    assert fim.digest(fim.fill_in_middle(frame.limit(0))).count() == 0


def test_rates_and_other_units(spark):
    frame = spark.createDataFrame([(i, f"some words stand here {i}") for i in range(400)], SCHEMA)
    forms = [r["form"] for r in fim.fill_in_middle(frame, rate=30, spm_rate=0).collect()]
    assert 60 < forms.count("psm") < 180 and forms.count("spm") == 0
    words = fim.fill_in_middle(frame, unit=r"\S+\s*").filter("n <> 5").count()
    assert words == 0
    with pytest.raises(Exception, match="units do not cover"):
        fim.fill_in_middle(frame, unit="[a-z]+").collect()
