"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans of several kinds. Four labelers vote on each (+1, 0, -1): the
kind's checksum or format rule, a gazetteer (domains' ends, dialling codes, issuers),
cue words before the span, and the characters around it. Votes over the whole
corpus are counted by pattern; expectation-maximisation on these counts (a few
hundred at most, whatever the corpus) estimates how reliable each labeler is and how
likely each pattern is a true span; a logistic classifier of votes and kind is
trained on that and decides about the spans that the base rules do not already fix.

Base spans (email, ip, card, phone, by the fixed rules below) always stay. Matches
that fail their rule are dropped; the classifier may add spans of the other kinds
that overlap no base span.

Patterns never backtrack: a start within a run of the pattern's own characters is
skipped unless the last match ended there, which changes no match and keeps long runs linear.
Places, overlaps and redacted texts are computed in time proportional to the text
(``common.running``, masks and UTF-32, whose parts are found without counting from the start).

Edge cases: null texts are empty and have no spans; offsets are code points, ends
exclusive; repeated rows each get their row; a corpus without candidates adds nothing;
an empty table gives an empty result; other columns pass through ``redact``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in order of output: the four base kinds, then those that only the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("ssn", "iban", "handle", "local_phone")
KINDS = BASE + ADDED

_SEP = r"(?: ?[\[(](?:at|AT)[\])] ?)"
_DOT = r"(?: ?[\[(](?:dot|DOT)[\])] ?|\.)"
PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}" + _SEP + r"[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,5}",
    "local_phone": r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+", "handle": None, "ip": ".", "card": None, "ssn": "-", "iban": None, "local_phone": None}

#: Gazetteers and cue words (fixed values).
ENDS = "com org net edu gov info io dev de fr es it nl eu uk us ca au ch at be br mx".split()
DIALS = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 81 82 86 91".split()
ISSUERS = "34 37 4 51 52 53 54 55 60 62 65".split()
CUES = "mail email contact write reach call tel phone mobile fax card visa credit account iban ssn social ip host address kontakt telefon karte konto correo tarjeta cuenta courriel carte compte".split()
AGAINST = "version isbn issn sku order invoice build rev sha md5 hash".split()

SPAN = "array<struct<kind:int,s:int,e:int,hit:string,before:string,around:string>>"
CONTEXT = 24
VOTERS = 4


def likely(kind: str, hit: Column) -> Column:
    """A cheap test that every match of a kind passes if it passes its rule."""
    n = F.length(hit)
    return {"card": n >= 16, "phone": n >= 9, "ip": F.lit(True)}.get(kind, F.lit(True))


def located(text: Column, kind: str) -> Column:
    """The matches of a kind's pattern whose rule holds or, for kinds that the method adds, all: ``kind, s, e, hit, before, around``.

    The gaps between matches and the matches themselves give the places; ``before`` is the end of the gap
    before a match, ``around`` the characters next to it.
    """
    pattern, number = PATTERN[kind], F.lit(KINDS.index(kind))
    none = F.array().cast(SPAN)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(x: Column) -> Column:
        gaps, found = x["gaps"], x["hits"]
        size = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, h: F.length(g) + F.length(h))
        start = common.running(size, lambda n: n, lambda a, b: a + b)
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), F.slice(gaps, F.lit(2), F.size(found)).alias("next"), start.alias("at"))
        zipped = F.filter(zipped, lambda z: likely(kind, z["hit"]) & passes_of(kind, z["hit"])) if kind in BASE else zipped

        def span(z: Column) -> Column:
            s = z["at"] + F.length(z["gap"])
            beside = F.concat(F.right(z["gap"], F.lit(1)), F.when((z["gap"] == "") & (z["at"] > 0), F.lit("x")).otherwise(F.lit("")), F.substr(z["next"], F.lit(1), F.lit(1)))
            return F.struct(number.alias("kind"), s.alias("s"), (s + F.length(z["hit"])).alias("e"), z["hit"].alias("hit"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), beside.alias("around"))

        return F.transform(zipped, span)

    found = common.once(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), spans)
    need = NEEDS[kind]
    quick = text.contains(need) if need else text.rlike(r"(?i)[\[(]at[\])]") if kind == "handle" else text.rlike("[0-9]")
    return F.when(quick & text.rlike(pattern), found).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    d = F.split(F.reverse(digits(hit)), "")
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an IBAN passes its check."""
    bare = F.replace(hit, F.lit(" "))
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, F.lit(100)).otherwise(F.lit(10)) + value(c)) % 97) == 1


def passes_of(kind: str, hit: Column) -> Column:
    """Whether a match holds the rule of its kind."""
    n = F.length(digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.concat(F.lit("0"), F.substr(F.ltrim(p, F.lit("0")), F.lit(1), F.lit(3))).cast("int") <= 255))
    if kind == "card":
        return n.between(16, 19) & luhn(hit)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "local_phone":
        return ~F.substr(digits(hit), F.lit(1), F.lit(1)).isin("0", "1")
    if kind == "ssn":
        return ~(F.substr(hit, F.lit(1), F.lit(3)).isin("000", "666") | hit.startswith("9") | hit.contains("-00-") | hit.endswith("-0000"))
    return mod97(hit) if kind == "iban" else F.lit(True)


def passes(kind: Column, hit: Column) -> Column:
    """The rule of the span's kind."""
    return reduce(lambda rest, k: F.when(kind == KINDS.index(k), passes_of(k, hit)).otherwise(rest), KINDS, F.lit(False))


def base_spans(text: Column) -> Column:
    """The base spans, in order of kind and start."""
    return F.concat(*[located(text, k) for k in BASE])


def mask(base: Column, kind: str) -> Column:
    """A byte for each character up to the last span of a kind: 1 within its spans, 0 between them."""
    own = F.filter(base, lambda b: b["kind"] == KINDS.index(kind))

    def drawn(spans: Column) -> Column:
        ends = F.slice(F.concat(F.array(F.lit(0)), F.transform(spans, lambda b: b["e"])), F.lit(1), F.size(spans))
        runs = F.zip_with(spans, ends, lambda b, end: F.concat(F.repeat(F.lit("0"), b["s"] - end), F.repeat(F.lit("1"), b["e"] - b["s"])))
        return F.array_join(runs, "").cast("binary")

    return common.once(own, drawn)


def other_spans(text: Column, base: Column) -> Column:
    """Candidates of the other kinds that overlap no base span."""
    def apart(found: Column) -> Column:
        def free(masks: Column) -> Column:
            return F.filter(found, lambda c: ~F.exists(masks, lambda m: F.substring(m, c["s"] + 1, c["e"] - c["s"]).cast("string").contains("1")))

        return F.when((F.size(found) == 0) | (F.size(base) == 0), found).otherwise(common.once(F.array(*[mask(base, k) for k in BASE]), free))

    return common.once(F.concat(*[located(text, k) for k in ADDED]), apart)


def votes(span: Column) -> list[Column]:
    """The labelers' votes on a span; the rules of base spans hold already."""
    hit, kind = span["hit"], span["kind"]
    lead = digits(F.substr(hit, F.lit(1), F.lit(8)))
    end = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    is_kind = lambda *ks: kind.isin(*[KINDS.index(k) for k in ks])
    listed = F.when(is_kind("email", "handle"), end.isin(*ENDS)).when(is_kind("phone"), reduce(Column.__or__, [lead.startswith(d) for d in DIALS])).when(is_kind("card"), reduce(Column.__or__, [lead.startswith(d) for d in ISSUERS]))
    before = F.lower(span["before"])
    cue = F.when(before.rlike(r"\b(?:" + "|".join(CUES) + r")\b"), 1).when(before.rlike(r"\b(?:" + "|".join(AGAINST) + r")\b"), -1).otherwise(0)
    return [
        F.when((kind < len(BASE)) | passes(kind, hit), 1).otherwise(-1),
        F.when(listed, 1).otherwise(0),
        cue,
        F.when(span["around"].rlike("[A-Za-z0-9_]"), -1).otherwise(1),
    ]


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__pii_text``, ``__pii_base`` and ``__pii_other``: base spans and other candidates."""
    rows = docs.withColumn("__pii_text", common.text_of(text))
    rows = rows.withColumn("__pii_base", base_spans(F.col("__pii_text")))
    return rows.withColumn("__pii_other", other_spans(F.col("__pii_text"), F.col("__pii_base")))


def voted(name: str) -> Column:
    """``kind, v0..v3`` of each span of a column."""
    return F.transform(name, lambda s: F.struct(s["kind"].alias("kind"), *[v.alias(f"v{i}") for i, v in enumerate(votes(s))]))


def patterns(rows: DataFrame) -> list[tuple[int, tuple[int, ...], int]]:
    """How often each kind and pattern of votes occurs over the corpus: at most 8 * 3 ** 4 rows."""
    columns = ["kind", *[f"v{i}" for i in range(VOTERS)]]
    seen = rows.select(F.explode(F.concat(voted("__pii_base"), voted("__pii_other"))).alias("x")).select("x.*").groupBy(*columns).count()
    return sorted((r["kind"], tuple(r[c] for c in columns[1:]), r["count"]) for r in seen.collect())


def estimate(seen: list, rounds: int = 50) -> list[float]:
    """Expectation-maximisation: how likely each pattern is a true span.

    Each labeler has, for true and for false spans, a probability of each vote.
    """
    belief = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v, _ in seen]
    for _ in range(rounds):
        prior = [1.0, 1.0]
        table = [[{-1: 0.5, 0: 0.5, 1: 0.5} for _ in range(VOTERS)] for _ in range(2)]
        for b, (_, v, n) in zip(belief, seen):
            for y, share in enumerate((1 - b, b)):
                prior[y] += share * n
                for i, vote in enumerate(v):
                    table[y][i][vote] += share * n
        for y in range(2):
            for counts in table[y]:
                total = sum(counts.values())
                for vote in counts:
                    counts[vote] /= total
        belief = []
        for _, v, _ in seen:
            odds = math.log(prior[1] / prior[0]) + sum(math.log(table[1][i][x] / table[0][i][x]) for i, x in enumerate(v))
            belief.append(1 / (1 + math.exp(-max(-40.0, min(40.0, odds)))))
    return belief


def features(kind: int, v: tuple[int, ...]) -> list[float]:
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *[float(x == 1) for x in v], *[float(x == -1) for x in v]]


def train(seen: list, belief: list[float], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """A logistic classifier of kind and votes, fitted to the beliefs."""
    rows = [(features(k, v), b, n) for (k, v, n), b in zip(seen, belief)]
    weight = [0.0] * (1 + len(KINDS) + 2 * VOTERS)
    mass = sum(math.sqrt(n) for *_, n in rows) or 1.0
    for _ in range(rounds):
        slope = [decay * w for w in weight]
        for x, b, n in rows:
            z = sum(w * f for w, f in zip(weight, x))
            error = (1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) - b) * math.sqrt(n) / mass
            for i, f in enumerate(x):
                slope[i] += error * f
        weight = [w - rate * s for w, s in zip(weight, slope)]
    return weight


def fit(docs: DataFrame) -> list[float]:
    """The classifier's weights, from the votes over all of ``docs``."""
    seen = patterns(with_spans(docs.select("text")))
    return train(seen, estimate(seen)) if seen else [-1.0] + [0.0] * (len(KINDS) + 2 * VOTERS)


def accepted(weight: list[float]) -> Column:
    """The other candidates that the classifier takes for true spans and whose rule holds."""

    def keep(s: Column) -> Column:
        v = votes(s)
        z = F.lit(weight[0]) + reduce(lambda rest, k: F.when(s["kind"] == k, F.lit(weight[1 + k])).otherwise(rest), range(len(KINDS)), F.lit(0.0))
        for i in range(VOTERS):
            z = z + F.when(v[i] == 1, F.lit(weight[1 + len(KINDS) + i])).when(v[i] == -1, F.lit(weight[1 + len(KINDS) + VOTERS + i])).otherwise(F.lit(0.0))
        return (z > 0) & passes(s["kind"], s["hit"])

    return F.filter("__pii_other", keep)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["s"].cast("string"), s["e"].cast("string"))), ",")


def find(docs: DataFrame, weight: list[float] | None = None) -> DataFrame:
    """``docs`` with ``__pii_kept`` (base) and ``__pii_added`` spans of each row."""
    weight = fit(docs) if weight is None else weight
    return with_spans(docs).withColumn("__pii_kept", F.col("__pii_base")).withColumn("__pii_added", accepted(weight)).drop("__pii_base", "__pii_other", "__pii_text")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of each document."""
    found = find(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("__pii_kept", lambda s: s["kind"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(F.col("__pii_kept")), 256).alias("base_sha256"), listed(F.concat("__pii_kept", "__pii_added")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; ``n_chars`` follows where it is there."""
    found = find(docs)
    spans = F.array_sort(F.transform(F.concat("__pii_kept", "__pii_added"), lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["kind"].alias("kind"))))
    label = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)

    def replaced(x: Column) -> Column:  # overlapping spans are replaced as one
        ordered, wide = x["spans"], x["wide"]
        text = lambda a, b: F.decode(F.substring(wide, a * 4 + 1, (b - a) * 4), "UTF-32")

        def joined(reach: Column) -> Column:
            parts = F.zip_with(ordered, reach, lambda s, r: F.when(s["s"] >= r, F.concat(text(r, s["s"]), label(s["kind"]))))
            end = F.greatest(F.element_at(reach, -1), F.element_at(ordered, -1)["e"])
            return F.concat(F.array_join(parts, ""), text(end, F.length(wide)))

        return common.once(common.running(ordered, lambda s: s["e"], lambda a, b: F.greatest(a, b)), joined)

    wide = F.encode("text", "UTF-32")
    rows = found.withColumn("__pii_cuts", spans)
    text = F.when(F.size("__pii_cuts") > 0, common.once(F.struct(F.col("__pii_cuts").alias("spans"), wide.alias("wide")), replaced)).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("__pii_cuts") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
