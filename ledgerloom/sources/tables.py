"""Sources and sinks: explicit schemas, bad-line reports, staged publishing, digests."""

from __future__ import annotations

import json
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def load(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines under a fixed schema; a malformed line keeps its text in ``_corrupt_record``."""
    return spark.read.schema(schema.add("_corrupt_record", "string")).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value, error) of the lines that are no JSON document; blank lines don't count, lines count from 1.

    Lines are numbered within the blocks of a file in which they are read, and blocks by the sums
    of those before them, so that a large file is not one task's.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = raw.groupBy("path", "_at").agg(F.count(F.lit(1)).alias("_n"))
    base = blocks.select("path", "_at", F.coalesce(F.sum("_n").over(before(Window.partitionBy("path").orderBy("_at"))), F.lit(0)).alias("_base"))
    numbered = raw.withColumn("_i", F.row_number().over(Window.partitionBy("path", "_at").orderBy("_id")))
    bad = numbered.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return bad.join(base, ["path", "_at"]).select("path", (F.col("_base") + F.col("_i")).alias("line"), "value", json_error("value").alias("error"))


@F.pandas_udf(StringType())
def json_error(s: pd.Series) -> pd.Series:
    """Why a text is no JSON document; null if it is one."""
    def why(t):
        def refuse(word):
            raise ValueError(f"no JSON number: {word}")

        try:
            json.loads(t, parse_constant=refuse)
        except (ValueError, RecursionError) as e:
            return str(e)
        return None

    return s.map(why)


def read_xlsx(spark: SparkSession, path: str, columns: list[str], sheet: int = 1) -> DataFrame:
    """(path, row, the columns) of one sheet of each workbook, as text: the header row gives the names, which must be ``columns``.

    A workbook is a zip of XML files; it is read whole by one task, as the format requires.
    """
    from pyspark.sql.types import LongType, StringType, StructField

    schema = StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(c, StringType()) for c in columns]])

    def run(batches):
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                header, *rows = sheet_cells(content, sheet)
                if header[1][: len(columns)] != columns:
                    raise ValueError(f"{where}: the header is {header[1]}")
                fit = lambda r: (r + [None] * len(columns))[: len(columns)]
                cells = list(zip(*[fit(r) for _, r in rows])) if rows else [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array([where] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int64()), *[pa.array(c, pa.string()) for c in cells]], names=["path", "row", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def sheet_cells(content: bytes, sheet: int = 1) -> list[tuple[int, list[str | None]]]:
    """(row number, cells) of a workbook's sheet from its XML: shared, inline and plain values; rows without values are left out."""
    import io
    import zipfile
    from xml.etree import ElementTree as ET

    tail = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if tail(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if tail(si) == "si"]
        root = ET.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in (e for e in root.iter() if tail(e) == "row"):
        cells: list[str | None] = []
        for c in (e for e in row if tail(e) == "c"):
            letters = [ord(x) - 64 for x in c.get("r", "") if x.isalpha()]
            at = sum(v * 26**i for i, v in enumerate(reversed(letters))) - 1 if letters else len(cells)
            cells += [None] * (at + 1 - len(cells))
            text = "".join(t.text or "" for t in c.iter() if tail(t) in ("v", "t"))
            cells[at] = shared[int(text)] if c.get("t") == "s" and text else text or None
        if any(v is not None for v in cells):
            out.append((int(row.get("r", len(out) + 1)), cells))
    return out


def scan_log(logs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Numbers from the dict literals (``{'loss': 1.2, ...}``) in free text: the other columns, seq (from 0) and the keys as doubles; literals without any of the keys don't count."""
    rest = [c for c in logs.columns if c != text]
    found = F.filter(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda t: F.rlike(t, F.lit("['\"](" + "|".join(keys) + ")['\"]\\s*:")))
    rows = logs.select(*rest, F.posexplode(found).alias("seq", "_t"))
    number = lambda k: F.regexp_extract("_t", rf"['\"]{k}['\"]\s*:\s*['\"]?([-+0-9.eE]+)", 1).try_cast("double").alias(k)
    return rows.select(*rest, "seq", *[number(k) for k in keys])


def build_tables(df: DataFrame, row: str, entity: str, lists: dict[str, str], sep: str = "; ", sentinel: str = "None identified after search") -> dict[str, DataFrame]:
    """Parent and child tables: the parent without its list columns, and for each a table (row, entity, term), exploded; sorted by row."""
    out = {"parent": df.drop(*lists.values()).sort(row)}
    for name, column in lists.items():
        held = df.where((F.col(column) != sentinel) & (F.trim(column) != ""))
        out[name] = held.select(row, entity, F.explode(F.split(column, sep)).alias("term")).distinct().sort(row, "term")
    return out


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines with sorted keys, nulls kept; one ordered file only where ``order`` asks for it."""
    lines = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"), *(order or []))
    (lines.coalesce(1).sortWithinPartitions(*order).select("value") if order else lines).write.mode("error").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def report(title: str, tables: dict[str, DataFrame], most: int = 1000) -> tuple[str, str]:
    """(Markdown, JSON) of small result tables; one of more than ``most`` rows is an error, not cut."""
    parts, data = [f"# {title}"], {}
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]]
        parts.append(f"## {name}\n\n" + "\n".join(lines))
        data[name] = [r.asDict(True) for r in rows]
    return "\n\n".join(parts) + "\n", json.dumps(data, sort_keys=True, default=str, ensure_ascii=False)


def read_csv(spark: SparkSession, path: str, schema: StructType, line_ends_in_cells: bool = False) -> DataFrame:
    """CSV with a header under a fixed schema; quotes inside quotes are doubled. Cells with line ends need ``line_ends_in_cells``, which makes each file one task."""
    return spark.read.schema(schema).option("header", True).option("escape", "\"").option("multiLine", line_ends_in_cells).csv(path)


def publish(df: DataFrame, path: str, gates: list[tuple[str, object]], fmt: str = "parquet") -> None:
    """Write to a staging path beside ``path``, check the gates on what was written, then rename.

    A gate is (name, function of the reread frame -> bool). Nothing appears at ``path`` if one
    fails or if ``path`` exists.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.format(fmt).save(stage)
    again = spark.read.schema(df.schema).format(fmt).load(stage)
    failed = [name for name, check in gates if not check(again)]
    if failed:
        fs.delete(jvm.org.apache.hadoop.fs.Path(stage), True)
        raise ValueError(f"gates failed: {', '.join(failed)}")
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), target):
        raise OSError(f"cannot publish {path}")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file of any size, read as a stream."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def pinned(spark: SparkSession, pins: dict[str, str]) -> None:
    """Refuse to go on unless every file has the digest it is pinned to; all that differ are named."""
    wrong = [path for path, sha256 in sorted(pins.items()) if file_digest(spark, path) != sha256]
    if wrong:
        raise ValueError(f"files differ from their pins: {', '.join(wrong)}")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of many files, each small enough for one cell (2 GB); ``file_digest`` streams larger ones."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """SHA-256 of the canonical JSON of the named columns."""
    return df.withColumn("content_sha256", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))
