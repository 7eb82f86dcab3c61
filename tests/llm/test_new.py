"""Operators 11 to 13 against brute force, on awkward and empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import cobucket, lexical, pii
from ledgerloom.llm.queries import QUERIES


def write(folder, name, rows, schema):
    pq.write_table(pa.Table.from_pylist(rows, schema=schema), folder / f"{name}.parquet")


# 11: personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(raw):
    ds = [int(c) for c in re.sub("[^0-9]", "", raw)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(ds)) % 10 == 0


def plain_base(text):
    out = []
    for number, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            raw = m.group()
            n = len(re.sub("[^0-9]", "", raw))
            if {"email": True, "ip": all(int(x) <= 255 for x in raw.split(".")) if kind == "ip" else True, "card": 14 <= n <= 19 and plain_luhn(raw), "phone": 10 <= n <= 15}[kind]:
                out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def with_luhn(head):
    return next(head + str(d) for d in range(10) if plain_luhn(head + str(d)))


CARD = with_luhn("453201511283036")
AWKWARD = [
    None, "", "   ", "a@b.c_x@d.e", "a@b@c.d.e, x..y@z.q- é@é.é w@é.com 😀 a@b.cc", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.1.1.256", f"{CARD} 12", f"x{CARD}y {CARD[:4]} {CARD[4:8]}-{CARD[8:12]} {CARD[12:]}",
    "+1 (269) 555-3296 4524132264652876", "+49 30 123456 +1 2 3", "++1 5555555555 +12345678901234567890", "5 5-5 5--5 " + "1" * 40, "a" * 50_000 + "@", "1" * 50_000, "1.1." * 20_000, "+1" + "(" * 50_000, "a@" + "b." * 50_000, "x@y.zz " * 20_000, "+1 555 555 5555 " * 5_000,
]
SAMPLES = [
    ("my IBAN DE89 3704 0044 0532 0130 00 is", "iban:8:35"), ("DE89370400440532013000", "iban:0:22"), ("DE88370400440532013000", ""), ("XDE89370400440532013000", ""), ("GB82 WEST 1234 5698 7654 32, yes", "iban:0:27"),
    ("call (269) 555-3296 now", "phone:5:19"), ("(269) 555-3296", ""), ("order 269-555-3296", ""), ("phone 269-555-3296", "phone:6:18"), ("telly 269-555-3296", ""),
    ("+1 (269) 555-3296 4524132264652876", f"phone:0:17{',card:18:34' if plain_luhn('4524132264652876') else ''}"), (f"tel 555-{CARD}", f"card:8:{8 + len(CARD)}"), (f"serial 5-{CARD} 77", ""), (f"visa: 5-{CARD} 77 part", f"card:8:{8 + len(CARD)}"),
    ("ssn 123-45-6789", "ssn:4:15"), ("123-45-6789", ""), ("ssn 000-45-6789", ""), ("social security: 123-45-6789.", "ssn:17:28"), (CARD, f"card:0:{len(CARD)}"), (CARD[:-1] + str((int(CARD[-1]) + 1) % 10), ""), ("nothing at all", ""),
    (f"{CARD[:4]} {CARD[4:8]} {CARD[8:12]} {CARD[12:]} 08 26", "card:0:19"),
]


def test_pii_base_is_the_contract_s(spark, tmp_path):
    random.seed(3)
    pieces = ["a@b.cd", "@", ".", "1", "23", "+1", " ", "-", "(", ")", "255.", "é", "x", CARD, "555", "😀", "_"]
    texts = AWKWARD + ["".join(random.choices(pieces, k=random.randint(1, 40))) for _ in range(3_000)]
    write(tmp_path, "documents", [dict(doc_id=i, text=t, base="b", spans=1) for i, t in enumerate(texts)], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("base", pa.string()), ("spans", pa.int64())]))
    got = {r.doc_id: r for r in QUERIES["op11_pii"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [s for _, _, s in plain_base(t)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t[:200]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s.startswith(f"{k}:") for s in base) for k in PATTERNS]
        assert set(base) <= set(got[i].spans.split(",")) or not base


def test_pii_adds_by_checksum_and_context(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAMPLES)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii.shown("spans").alias("s")).collect()}
    assert [got[i] for i in range(len(SAMPLES))] == [w for _, w in SAMPLES]


def test_pii_keeps_other_columns_and_runs_no_python(spark):
    df = spark.createDataFrame([(None, "a@b.cd", 1), (None, "a@b.cd", 1)], "doc_id long, text string, score int")
    out = pii.find_pii(df)
    assert out.columns == ["doc_id", "text", "score", "base", "spans"] and out.count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and pii.find_pii(df.limit(0)).count() == 0


# 12: lexical search


def plain_search(docs, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    found = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in docs]
    found = [(d, c) for d, c in found if c]
    total, df = sum(sum(c.values()) for _, c in found), Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in found:
            m = 50 + 50 * sum(c.values()) * len(found) // total
            s = sum(math.floor(1000 * math.log((2 * len(found) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(term.findall((text or "").translate(low))) if t in c)
            if s > 0:
                scores.append((-s, 2**63 if d is None else d))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"block_items": 3, "chunk": 50}, {"block_terms": 10, "chunk": 1}, {"k": 2}])
def test_lexical_is_brute_force(spark, settings):
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["É", "Ab", "aB", "ß x", "10", "😀"]
    docs = [(i % 180, " ".join(random.choices(words, [1 / (j + 1) for j in range(len(words))], k=random.randint(0, 60)))) for i in range(400)]
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, None), (8, ""), (9, " \t-"), (10, "w1 " * 100_000)] + [(1000 + i, "w5 w6 w7 w8") for i in range(120)]
    items = [(i, " ".join(random.choices(words, k=12))) for i in range(20)] + [(3, "w1 w50"), (None, "W1"), (30, None), (31, "--"), (32, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("x")).withColumn("rank", F.lit(0)).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc", F.lit("x"))
    got = sorted(((r.item_id, r["rank"], 2**63 if r.doc_id is None else r.doc_id, r.score) for r in lexical.search(d, q, **settings).collect()), key=str)
    assert got == plain_search(docs, items, settings.get("k", 50))


def test_lexical_without_rows(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(none, some).count() == 0
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), some.limit(0)).count() == 0


# 13: co-bucketed pair

SALES = pa.schema([("sale_id", pa.int64()), ("client_id", pa.int64()), ("status", pa.string()), ("total", pa.float64()), ("sold_at", pa.timestamp("us")), ("arrived_at", pa.timestamp("us")), ("priority", pa.int32()), ("part", pa.string()), ("Number", pa.string())])
LINES = pa.schema([("sale_id", pa.int64()), ("line_no", pa.int32()), ("item_id", pa.int64()), ("vendor_id", pa.int64()), ("quantity", pa.int32()), ("amount", pa.float64()), ("discount", pa.float64()), ("flag", pa.string()), ("shipped_at", pa.timestamp("us")), ("bucket", pa.int32()), ("joined", pa.string())])


def pair(n, hot):
    random.seed(n)
    some = lambda x: None if random.random() < 0.05 else x
    when = lambda: some(datetime(2024, 1, 1 + random.randrange(28), random.randrange(24)))
    key = lambda top: some(7 if hot and random.random() < 0.5 else random.randrange(top))
    sales = [dict(sale_id=key(n), client_id=some(1), status=some(random.choice(["é", "z", "😀", "￮"])), total=some(random.random()), sold_at=when(), arrived_at=when(), priority=some(3), part="p", Number=None) for _ in range(n)]
    lines = [dict(sale_id=key(n + n // 4), line_no=some(1), item_id=some(random.randrange(40)), vendor_id=1, quantity=some(2), amount=1.5, discount=None, flag=some("f"), shipped_at=when(), bucket=5, joined="x") for _ in range(4 * n)]
    return sales + sales[:5], lines + lines[:5]


def crc(text):
    return zlib.crc32(text.encode()) % 300


@pytest.mark.parametrize("n,hot", [(0, False), (60, False), (1500, False), (1500, True)])
def test_cobucket_is_brute_force(spark, tmp_path, n, hot):
    sales, lines = pair(n, hot) if n else ([], [])
    write(tmp_path, "sales", sales, SALES)
    write(tmp_path, "sale_lines", lines, LINES)
    rows = [r.asDict() for r in QUERIES["op13_cobucket"](spark, str(tmp_path)).collect()]
    ids = {r["sale_id"] for r in sales} - {None}
    sale_b = lambda i: 301 if i is None else crc(f"line{i}")
    line_b = lambda i: 301 if i is None else crc(f"line{i}") if i in ids else 300
    byte = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    seen = set()
    for name, table, schema, bucket, start in (
        ("sales", sales, SALES, sale_b, lambda r: sale_b(r["sale_id"]) - (sale_b(r["sale_id"]) % 3 == 1)), ("sale_lines", lines, LINES, line_b, lambda r: 0 if r["item_id"] is None else crc(str(r["item_id"])))
    ):
        final, starts = defaultdict(list), defaultdict(list)
        for r in table:
            final[bucket(r["sale_id"])].append(r)
            starts[start(r)].append(r)
        own = {r["bucket"]: r for r in rows if r["table_name"] == name}
        assert sorted(own) == sorted(final)
        for b, want in final.items():
            got = own[b]
            want.sort(key=lambda r: [byte(r[c]) for c in schema.names])
            path = got["path"].removeprefix("file:")
            file = pq.ParquetFile(path)
            assert file.schema_arrow.names == schema.names and got["columns"] == ",".join(schema.names)
            assert file.read().to_pylist() == want and got["n_rows"] == len(want)
            assert got["ids_sha256"] == hashlib.sha256(",".join("" if r["sale_id"] is None else str(r["sale_id"]) for r in want).encode()).hexdigest()
            n_from = Counter(start(r) for r in want)
            assert got["lineage_sha256"] == hashlib.sha256(",".join(f"{s}:{n_from[s]}" for s in sorted(n_from)).encode()).hexdigest()
            assert got["rewritten"] == (not (len(n_from) == 1 and len(starts[next(iter(n_from))]) == len(want)))
            assert got["n_joined"] == sum(sum(s["sale_id"] == r["sale_id"] for s in sales) for r in want) if name == "sale_lines" and b < 300 else True
            assert b < 300 or got["n_joined"] == 0
            seen.add(os.path.abspath(path))
    if seen:
        root = os.path.dirname(os.path.dirname(os.path.dirname(next(iter(seen)))))
        assert seen == {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs}


def test_cobucket_keeps_files_that_are_right(spark, tmp_path):
    """Starting files by bucket already: all stay, and nothing is rewritten."""
    keys = spark.range(200).selectExpr("id AS k", "id % 7 AS v")
    own = cobucket.own_bucket(F.col("k"), 16)
    out = cobucket.cobucket(keys, keys.unionAll(keys), "k", ((own, 18), (own + 100, 18)), f"file://{tmp_path}/pair", buckets=16).collect()
    assert not any(r.rewritten for r in out) and sum(r.n_rows for r in out) == 600 and sum(r.n_joined for r in out) == 800
