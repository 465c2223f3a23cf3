from __future__ import annotations

import hashlib
import re

import pytest

from cohortcast.llm import pii
from cohortcast.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> str:
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if keep:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


TEXTS = [
    None, "", "nothing here", "a@b.c@d.e x%y@z.w.v, foo@bar", "a@b.cd%e@x.y", "1.2.3.4.5.6.7.8 300.1.1.1 0255.001.2.3",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (736) 555-2678, +12345", "é€𝒳 +44 20 7946 0958 é a@b.co",
    "IBAN DE89 3704 0044 0532 0130 00.", "XX00 1234 5678 9012 345", "social security 123-45-6789", "123-45-6789",
    "x" * 200_000 + "@" + "y.z" * 50_000, "a@b.co " * 20_000, "1." * 100_000, "+1" + "(" * 100_000, "9" * 100_000,
    "1.2.3.4\n" * 3000,
]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, "other", 1) for i, t in enumerate(TEXTS)] + [(None, "a@b.co", "o", 2), (3, TEXTS[3], "o", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, pii int")
    got = pii.digest(pii.find_pii(df)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text in enumerate(TEXTS):
        want = base_spans(text or "")
        assert by_id[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want[:100], by_id[i].spans[:100])
        assert by_id[i].n_email == len(re.findall("email:", want))


def test_checksums_and_context(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(df)).collect()}
    assert "iban:5:32" in got[9] and "iban" not in got[10]
    assert "ssn:16:27" in got[11] and got[12] == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(pii.find_pii(df)).collect() == []


@pytest.mark.parametrize("name", ["op10_pii_spans"])
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, connect(SF_DIR), ORACLES[name]) == []
