r"""Personal data in texts [native]: patterns propose spans, validators confirm them, context words adjust the score.

*Base* spans (``BASE``) are the matches of four patterns, leftmost and without overlaps, that pass
their kind's test: emails, IPv4 addresses with parts of at most 255, cards of 14 to 19 digits that
pass Luhn, phones with a plus sign and 10 to 15 digits. They always stay.

*Further* spans (``FURTHER``) come from looser proposals, scored in points: what the pattern alone
is worth, a checksum that must hold where the kind has one (Luhn, mod-97), ``CONTEXT`` points more
near a word that speaks for the kind and as many less near one that speaks against personal data.
Those of at least ``LEAST`` points that overlap no base span are added: cards inside longer digit
chains, phones without a plus sign or beside other digits, IBANs, social security numbers. A word is
near if it stands in the 40 code points before or the 20 after, as far as the next proposal of the
same pattern.

All of it is one projection: no shuffle, no Python. A pattern tells matches and the pieces between
them; offsets are running sums of their lengths, formed by doubling (the sum over 1, 2, 4, ...
neighbours), so that a text with a million matches takes twenty linear steps. Patterns are
written so that every text takes linear time: runs are possessive, and an email is only tried where
a run of its characters starts or where the last match ended, which finds the same matches.

Defined results: a null text is empty and has no spans; rows, repeated ones and those with null doc_ids
included, each give one row; an empty table gives none; other columns stay, but for those named like
``RESULTS``, which are replaced. A text is held by one task, some tens of bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
RESULTS = ["spans", "base"]
#: Points that make a span, and what a context word adds or takes.
LEAST, CONTEXT = 6, 3
BEFORE, AFTER = 40, 20
AGAINST = ["order", "invoice", "ticket", "sku", "serial", "isbn", "version", "tracking", "part", "article", "item"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def luhn(raw: Column) -> Column:
    """The digits' checksum: every second one from the right doubled, digits of the products summed, a multiple of ten."""
    one = lambda d, i: F.when(i % 2 == 0, d).otherwise((2 * d) % 10 + F.floor(d / 5).cast("int"))
    each = F.transform(F.split(F.reverse(digits(raw)), ""), lambda c, i: one(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod_97(raw: Column) -> Column:
    """Four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(raw, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    add = lambda a, c: F.when(c >= "A", (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def between(raw: Column, low: int, high: int) -> Column:
    return F.char_length(digits(raw)).between(low, high)


@dataclass(frozen=True)
class Base:
    kind: str
    pattern: str  # as a contract states it
    fast: str  # the same matches in linear time
    hint: str  # what every match holds
    test: Callable[[Column], Column]


OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
OCTETS = rf"^{OCTET}(\.{OCTET}){{3}}\z"

BASE = [
    Base("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda raw: F.lit(True)),
    Base("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", lambda raw: raw.rlike(OCTETS)),
    # One digit alone is no match of the contract's pattern and has too few digits here.
    Base("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9][ -]?[0-9][ -]?[0-9]", lambda raw: between(raw, 14, 19) & luhn(raw)),
    Base("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", lambda raw: between(raw, 10, 15)),
]


@dataclass(frozen=True)
class Further:
    kind: str
    pattern: str
    not_before: str  # characters that may not stand before it, or after it
    not_after: str
    words: tuple[str, ...]
    points: Callable[[Column], Column]


CARD = ("card", "visa", "mastercard", "amex", "credit", "debit", "karte", "tarjeta", "carte")
PHONE = ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "telefono", "telephone", "handy")

FURTHER = [
    Further("card", "[0-9]{13,}", "[0-9]", "[0-9]", CARD, lambda raw: F.when((F.char_length(raw) <= 19) & raw.rlike("^[2-6]") & luhn(raw), 7).otherwise(-9)),
    Further("card", "[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", "[0-9]", "[0-9]", CARD, lambda raw: F.when(raw.rlike("^[2-6]") & luhn(raw), 7).otherwise(-9)),
    Further("phone", r"(\+[0-9]{1,3}[ .-]?)?(\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "[0-9+]", "[0-9]", PHONE, lambda raw: F.when(raw.startswith("+"), 7).when(raw.startswith("("), 5).otherwise(3)),
    Further("iban", "[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)", "[A-Za-z0-9]", "[A-Za-z0-9]", ("iban", "account", "bank", "konto", "cuenta", "compte"), lambda raw: F.when(mod_97(raw), 9).otherwise(-9)),
    Further("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9-]", "[0-9-]", ("ssn", "social security"), lambda raw: F.when(raw.rlike("^(000|666|9)|-00-|-0000"), -9).otherwise(4)),
]
HINTS = ["[0-9]{13}", "[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", r"[0-9]{3}[ .-][0-9]{4}", "[A-Z]{2}[0-9]{2}", "[0-9]{3}-[0-9]{2}-"]


def near(words: list[str] | tuple[str, ...]) -> str:
    """A pattern for any of the words, apart from other letters, in any case."""
    return f"(?i)(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|\\z)"


def running_sums(sizes: Column) -> Column:
    """The sum of each entry and all before it: log2 steps, each adding the entry 1, 2, 4, ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(sizes), F.lit(1)).cast("double"))).cast("int"))
    add = lambda sums, j: F.transform(sums, lambda x, i: x + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), j)), F.lit(0).cast("long")))
    return F.aggregate(steps, sizes, add)


def located(text: Column, pattern: str, around: bool = False) -> Column:
    """array<struct<start, end, raw>> of the matches, in code points; ``around``: also the texts before and after, and whether they end there."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def place(s: Column) -> Column:
        n = F.size(s["m"])
        gaps = F.slice(s["g"], F.lit(1), n)
        ends = running_sums(F.zip_with(gaps, s["m"], lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long")))
        spans = F.zip_with(ends, s["m"], lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("raw")))
        if not around:
            return spans
        sides = F.zip_with(gaps, F.slice(s["g"], F.lit(2), n), lambda a, b: F.struct(F.right(a, F.lit(BEFORE)).alias("before"), F.left(b, F.lit(AFTER)).alias("after")))
        with_sides = F.zip_with(spans, sides, lambda x, y: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["raw"].alias("raw"), y["before"].alias("before"), y["after"].alias("after")))
        return F.transform(with_sides, lambda x, i: F.struct(*[x[c].alias(c) for c in ("start", "end", "raw", "before", "after")], (i == 0).alias("first"), (i == n - 1).alias("last")))

    return let(found, place)


def span(kind: str, x: Column, score: Column) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("number"), x["end"].alias("end"), F.lit(kind).alias("kind"), score.cast("int").alias("score"), x["raw"].alias("raw"))


NONE = "array<struct<start:bigint,number:int,end:bigint,kind:string,score:int,raw:string>>"


def base_spans(text: Column, rule: Base) -> Column:
    found = F.transform(F.filter(located(text, rule.fast), lambda x: rule.test(x["raw"])), lambda x: span(rule.kind, x, F.lit(10)))
    return F.coalesce(F.when(text.rlike(rule.hint), found), F.array().cast(NONE))


def further_spans(text: Column, rule: Further, hint: str, least: int) -> Column:
    def apart(x: Column) -> Column:
        left = (x["first"] | (x["before"] != "")) & ~x["before"].rlike(rule.not_before + r"\z")
        return left & (x["last"] | (x["after"] != "")) & ~x["after"].rlike("^" + rule.not_after)

    def score(x: Column) -> Column:
        says = lambda words: (x["before"].rlike(near(words)) | x["after"].rlike(near(words))).cast("int")
        return rule.points(x["raw"]) + CONTEXT * (says(rule.words) - says(AGAINST))

    found = F.transform(F.filter(located(text, rule.pattern, True), apart), lambda x: span(rule.kind, x, score(x)))
    return F.coalesce(F.when(text.rlike(hint), F.filter(found, lambda x: x["score"] >= least)), F.array().cast(NONE))


def find_pii(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``base`` and ``spans`` (base and further ones): arrays of (start, number, end, kind, score, raw) by start, then kind."""
    docs = docs.drop(*RESULTS)
    body = utf8(text)
    base = F.concat(*[base_spans(body, rule) for rule in BASE])
    more = F.concat(*[further_spans(body, rule, hint, least) for rule, hint in zip(FURTHER, HINTS)])
    both = docs.withColumns({"base": base, "spans": more})
    new = F.filter("spans", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return both.withColumns({"base": F.array_sort("base"), "spans": F.array_sort(F.array_distinct(F.concat("base", new)))})


def shown(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = find_pii(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS[:4]]
    return docs.select("doc_id", *counts, F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"))


def oracle_sql() -> str:
    """The same rows in DuckDB, from the contract's own patterns."""
    digits_of, said = "regexp_replace(raw, '[^0-9]', '', 'g')", lambda words: f"(regexp_matches(before_, '{near(words)}') OR regexp_matches(after_, '{near(words)}'))::INT"
    checks = {}
    checks["luhn"] = f"list_sum([CASE WHEN i % 2 = 1 THEN ({digits_of})[-i]::INT ELSE (2 * ({digits_of})[-i]::INT) % 10 + ({digits_of})[-i]::INT // 5 END FOR i IN range(1, length({digits_of}) + 1)]) % 10 = 0"
    plain = "replace(raw, ' ', '')"
    checks["mod97"] = f"list_reduce(list_prepend(0, [CASE WHEN c >= 'A' THEN 100 + ascii(c) - 55 ELSE ascii(c) - 48 END FOR c IN string_split(({plain})[5:] || ({plain})[:4], '')]), lambda a, v: CASE WHEN v >= 100 THEN (a * 100 + v - 100) % 97 ELSE (a * 10 + v) % 97 END) = 1"
    tests = {"email": "true", "ip": f"regexp_matches(raw, '{OCTETS}')", "card": f"length({digits_of}) BETWEEN 14 AND 19 AND {checks['luhn']}", "phone": f"length({digits_of}) BETWEEN 10 AND 15"}
    points = [
        f"CASE WHEN length(raw) <= 19 AND regexp_matches(raw, '^[2-6]') AND {checks['luhn']} THEN 7 ELSE -9 END", f"CASE WHEN regexp_matches(raw, '^[2-6]') AND {checks['luhn']} THEN 7 ELSE -9 END",
        "CASE WHEN raw[1] = '+' THEN 7 WHEN raw[1] = '(' THEN 5 ELSE 3 END", f"CASE WHEN {checks['mod97']} THEN 9 ELSE -9 END", "CASE WHEN regexp_matches(raw, '^(000|666|9)|-00-|-0000') THEN -9 ELSE 4 END",
    ]
    parts = []
    for k, pattern in enumerate([*(b.pattern for b in BASE), *(f.pattern for f in FURTHER)]):
        rule = FURTHER[k - 4] if k > 3 else BASE[k]
        keep = tests[rule.kind] if k < 4 else (
            f"(i = 1 OR before_ <> '') AND (i = n OR after_ <> '') AND NOT regexp_matches(before_, '{rule.not_before}\\z') AND NOT regexp_matches(after_, '^{rule.not_after}')"
            f" AND {points[k - 4]} + {CONTEXT} * ({said(rule.words)} - {said(AGAINST)}) >= {LEAST}"
        )
        parts.append(
            f"SELECT r, {k < 4} AS base, '{rule.kind}' AS kind, {KINDS.index(rule.kind)} AS number, e - length(raw) AS s, e FROM ("
            f"SELECT r, i, len(m) AS n, m[i] AS raw, right(g[i], {BEFORE}) AS before_, left(g[i + 1], {AFTER}) AS after_, sum(length(m[i]) + length(g[i])) OVER (PARTITION BY r ORDER BY i) AS e"
            f" FROM (SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d))) WHERE {keep}"
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 p AS ({' UNION ALL '.join(parts)}),
 q AS (SELECT DISTINCT * FROM p WHERE base OR NOT EXISTS (SELECT 1 FROM p b WHERE b.base AND b.r = p.r AND b.s < p.e AND p.s < b.e)),
 j AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, number) FILTER (base) AS b,
  {', '.join(f"count(*) FILTER (base AND kind = '{k}') AS n_{k}" for k in KINDS[:4])} FROM q GROUP BY r)
 SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS[:4])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)"""
