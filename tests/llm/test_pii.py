"""Personal data: base spans against Python's regular expressions, classifier and redaction."""

import hashlib
import re

from pyspark.sql import functions as F

from .test_operators import docs_of

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, rule in RULES.items() for m in re.finditer(rule, text or "") if holds(k, m[0])]


TEXTS = [
    None, "", "nothing here", "mail a.b@c.de, x@y or z@w.org.uk. a@b.c_d@e.f a@b@c.d .@-.-", "1.2.3.4 1.2.3.4.5 256.1.1.1 0001.002.03.4 999999999999.1.1.1 1..2.3.4",
    "é 4111 1111 1111 1111 ü 4111-1111-1111-1112 4111111111111111111 5500005555555559 x", "+1 (743) 555-3824 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +49(30)1234567)) +1-",
    "call +1 555 010 9999 ssn 123-45-6789 000-12-3456 GB82 WEST 1234 5698 7654 32 iban GB82 WEST 1234 5698 7654 33 tel (212) 555-0199 joe [at] mail [dot] com",
    "a" * 60_000, "1" * 60_000, "a@b" + ".c" * 20_000, "1 " * 20_000, "+1" + "(" * 20_000, "x@y.z " * 1500, "12 x " * 30_000, "1.1.1.1 123-45-6789 " * 3_000, "\U0001f600 u@v.com \U0001f600 1.1.1.1",
]


def test_base_spans(spark):
    from meshweave.llm.pii import digest

    rows = {r["doc_id"]: r for r in digest(docs_of(spark, [*TEXTS, TEXTS[3]])).collect()}
    for i, text in enumerate([*TEXTS, TEXTS[3]]):
        want = brute(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = rows[i]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), (i, listed[:200], r["spans"][:200])
        assert [r[f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in want) for k in RULES]
        assert r["spans"].startswith(listed)
    assert digest(docs_of(spark, TEXTS).where(F.lit(False))).count() == 0


def test_method_adds_and_redacts(spark):
    from meshweave.llm.pii import digest, redact

    texts = [f"call me: +1 555 010 {1000 + i} or mail u{i}@x.com" for i in range(30)] + ["my ssn 123-45-6789, mail joe [at] mail [dot] com", "version 000-12-3456 only", "clean text"]
    docs = docs_of(spark, texts).withColumn("__pii_text", F.lit(1)).withColumn("base", F.lit("kept"))
    spans = {r["doc_id"]: r["spans"] for r in digest(docs).collect()}
    assert "ssn:7:18" in spans[30] and "handle" in spans[30] and spans[31] == "" and spans[32] == ""
    out = {r["doc_id"]: r for r in redact(docs.select("doc_id", "text", "lang", "base", "n_chars")).collect()}
    assert out[0]["text"] == "call me: [PHONE] or mail [EMAIL]" and out[32]["text"] == "clean text" and out[0]["base"] == "kept"
    assert out[30]["text"].startswith("my ssn [SSN], mail [HANDLE]") and out[31]["text"] == texts[31]


def test_estimation_finds_reliable_labelers():
    from meshweave.llm.pii import estimate

    seen = [(0, (1, 1, 0, 1), 900), (0, (1, 0, 0, 1), 100), (2, (-1, 0, 0, 1), 400), (2, (-1, 0, -1, -1), 300)]
    belief = estimate(seen)
    assert belief[0] > 0.9 and belief[3] < 0.1 and belief[1] > belief[2]
