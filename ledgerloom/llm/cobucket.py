"""Co-bucketed pair of tables: a parent and its children brought to one file a table and bucket, planned on metadata.

The bucket of a row is the unsigned crc32 of ``SALT`` and its decimal key, modulo ``buckets``. Children
whose key no parent has take bucket ``buckets``, rows with a null key ``buckets + 1``.

1. ``write_start`` writes a table in numbered starting files by a rule of the caller's.
2. ``contingency`` aggregates (starting file, bucket, rows): a matrix of at most files x buckets entries.
3. ``plan`` reads the matrix only: a file whose row has one entry, in a column that has one entry, holds just a
   final file's rows, and stays. Every other bucket is rewritten, from the files its column lists.
4. ``rewrite`` reads the listed files once, deals rows to buckets, sorts and writes; the sources go
   after the new files are committed, so that a run that dies leaves all rows in place.
5. ``facts`` reads the key column of the final files, in file order, for their digests.

Rows of all files are sorted by key, then by the rest of the columns from left to right, nulls first, strings by bytes.
Both tables' buckets hold the same keys, so that later joins on the key need no exchange.

What goes to the driver: names of files (as many as files and buckets), never rows. Which keys the
parents lack is found on counts a key, so a hot key is one row there; rows get that answer by a shuffled join,
except for keys with over 1/``HOT`` of the children, of which there are fewer than ``HOT``, by a broadcast.
A final file is written by one task that sorts with spilling, however hot its bucket; that is the contract's demand.

Defined results: an empty table has no files and gives no rows; repeated rows stay; a bucket without
rows has no file; extra columns of any name are carried (helper columns get names that no column has).
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import drop_tables, persist_table, shared_dir, table

SALT, BUCKETS, HOT = "line", 300, 256


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores until no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def decimal_crc(key: Column, salt: str, modulus: int) -> Column:
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % modulus).cast("int")


def own_bucket(key: Column, buckets: int, salt: str = SALT) -> Column:
    return F.when(key.isNull(), buckets + 1).otherwise(decimal_crc(key, salt, buckets))


def tasks(spark: SparkSession, files: int) -> int:
    return min(files, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_files(df: DataFrame, columns: list[str], key: str, number: str, prefix: str, path: str, files: int) -> None:
    """One sorted file for each value of ``number``, in folders part=<prefix><number> that hold ``columns``."""
    part = fresh(df.columns, "part")
    rest = [c for c in columns if c != key]
    dealt = df.repartition(tasks(df.sparkSession, files), number).withColumn(part, F.concat(F.lit(prefix), F.col(number).cast("string")))
    # The writer wants its folders in order; sorting by them first leaves it nothing to sort.
    dealt.sortWithinPartitions(part, F.asc_nulls_first(key), *[F.asc_nulls_first(c) for c in rest]).select(*columns, part).write.mode("append").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).partitionBy(part).parquet(path)


def write_start(df: DataFrame, key: str, number: Column, path: str, files: int) -> None:
    name = fresh(df.columns, "number")
    write_files(df.withColumn(name, number), df.columns, key, name, "s", path, files)


class Folder:
    """One table's folder: its files by part."""

    def __init__(self, spark: SparkSession, path: str, like: DataFrame):
        self.spark, self.path, self.schema, self.columns = spark, path, like.schema, like.columns
        self.part = fresh([*like.columns, "number"], "part")
        jvm = spark.sparkContext._jvm
        self.at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def parts(self) -> list[str]:
        """As many as files."""
        if not self.fs.exists(self.at(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.at(self.path))]
        return sorted(n.split("=", 1)[1] for n in names if "=" in n)

    def folder(self, part: str) -> str:
        return f"{self.path}/part{'_' * (len(self.part) - 4)}={part}"

    def read(self, parts: list[str], columns: list[str] | None = None) -> DataFrame:
        """Rows with ``file`` (Spark's _metadata) at hand; no parts: no rows."""
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn(self.part, F.lit(None).cast("string"))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField(self.part, StringType())])).option("basePath", self.path).parquet(*[self.folder(p) for p in parts])

    def drop(self, parts: list[str]) -> None:
        for p in parts:
            self.fs.delete(self.at(self.folder(p)), True)

    def drop_checksums(self) -> None:
        """Local file systems write a .crc file beside each file; only data files shall remain."""
        raw = getattr(self.fs, "getRawFileSystem", None) if self.fs.getScheme() == "file" else None
        if raw is not None and self.fs.exists(self.at(self.path)):
            raw = self.fs.getRawFileSystem()
            for top in [self.at(self.path), *(self.at(self.folder(p)) for p in self.parts())]:
                for s in raw.listStatus(top):
                    if s.getPath().getName().endswith(".crc"):
                        raw.delete(s.getPath(), False)


def key_counts(parents: DataFrame, children: DataFrame, key: str, buckets: int) -> DataFrame:
    """key, parents, children, bucket: a row a key that is not null, stored."""
    of = lambda df, name: df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias(name))
    both = of(parents, "parents").join(of(children, "children"), "key", "full").na.fill(0, ["parents", "children"])
    return persist_table(both.withColumn("bucket", F.when(F.col("parents") == 0, buckets).otherwise(own_bucket(F.col("key"), buckets))), "cobucket-keys")


def with_bucket(df: DataFrame, key: str, name: str, keys: DataFrame | None, buckets: int) -> DataFrame:
    """Add each row's bucket; ``keys``: where some keys have no parent."""
    own = own_bucket(F.col(key), buckets)
    if keys is None:
        return df.withColumn(name, own)
    orphans = keys.where("parents = 0").select(F.col("key").alias("_key"), "children")
    total = keys.agg(F.coalesce(F.sum("children"), F.lit(0))).first()[0]
    hot = [r.key for r in keys.where(F.col("children") * HOT > total).select("key").collect()]  # fewer than HOT
    lone = [r._key for r in orphans.where(F.col("children") * HOT > total).collect()]
    # Hot keys get their answer from this list; their rows then carry no key into the join, and are spread over it.
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    joined = fresh(df.columns, "joined")
    rows = df.withColumn(joined, F.when(~is_hot, F.col(key)))
    plain = rows.where(F.col(joined).isNull()).withColumn(name, F.when(F.col(key).isin(lone), buckets).otherwise(own) if lone else own)
    rest = rows.where(F.col(joined).isNotNull()).join(orphans.select("_key"), F.col(joined) == F.col("_key"), "left")
    rest = rest.withColumn(name, F.when(F.col("_key").isNotNull(), buckets).otherwise(own)).drop("_key")
    return plain.unionByName(rest).drop(joined)


def contingency(rows: DataFrame, part: str, bucket: str) -> DataFrame:
    """file, bucket, n: entries of the matrix that are not 0, stored."""
    return persist_table(rows.groupBy(F.substring(part, 2, 20).cast("int").alias("file"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "cobucket-matrix")


def plan(matrix: DataFrame) -> DataFrame:
    """bucket, n_rows, files, lineage (array of file:n, ascending), kept (a file that is just this bucket's rows, or null)."""
    widths = matrix.groupBy("file").agg(F.count(F.lit(1)).alias("width"))
    each = F.array_sort(F.collect_list(F.struct("file", "n", "width")))  # as long as there are starting files
    columns = matrix.join(widths, "file").groupBy("bucket").agg(F.sum("n").alias("n_rows"), each.alias("from"))
    single = (F.size("from") == 1) & (F.col("from")[0]["width"] == 1)
    return columns.select(
        "bucket", "n_rows", F.transform("from", lambda x: x["file"]).alias("files"), F.transform("from", lambda x: F.concat_ws(":", x["file"].cast("string"), x["n"].cast("string"))).alias("lineage"),
        F.when(single, F.col("from")[0]["file"]).alias("kept"),
    )


def rewrite(folder: Folder, key: str, matrix: DataFrame, keys: DataFrame | None, buckets: int) -> DataFrame:
    """Carry out the plan of one table; returns it, stored."""
    made = persist_table(plan(matrix), "cobucket-plan")
    kept = {f"s{r.kept}" for r in made.where("kept IS NOT NULL").select("kept").collect()}  # names of files
    sources = [p for p in folder.parts() if p not in kept]
    if sources:
        bucket = fresh([*folder.columns, folder.part], "bucket")
        rows = with_bucket(folder.read(sources).drop(folder.part), key, bucket, keys, buckets)
        write_files(rows, folder.columns, key, bucket, "b", folder.path, buckets + 2)
        folder.drop(sources)
    folder.drop_checksums()
    return made


def facts(folder: Folder, key: str) -> DataFrame:
    """part, path, n_rows, ids_sha256 of each file: its keys in file order, hashed in a stream."""

    def run(stream):
        now, digest, n = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], names=["part", "path", "n_rows", "ids_sha256"])
        for batch in stream:
            paths = batch.column("path")
            lo = 0
            while lo < batch.num_rows:
                own = (batch.column("part")[lo].as_py(), paths[lo].as_py())
                hi = lo + int(pa.compute.sum(pa.compute.equal(paths.slice(lo), own[1])).as_py())  # rows of one path stand together
                if own != now:
                    if now is not None:
                        yield done()
                    now, digest, n = own, hashlib.sha256(), 0
                ids = ",".join("" if x is None else str(x) for x in batch.column("id").slice(lo, hi - lo).to_pylist())
                digest.update((("," if n else "") + ids).encode())
                n += hi - lo
                lo = hi
        if now is not None:
            yield done()

    files = folder.read(folder.parts()).select(F.col(folder.part).alias("part"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), F.col(key).alias("id")) if folder.parts() else None
    if files is None:
        return folder.spark.createDataFrame([], "part string, path string, n_rows long, ids_sha256 string")
    dealt = files.repartition(tasks(folder.spark, len(folder.parts())), "path").sortWithinPartitions("path", "row")
    return dealt.select("part", "path", "id").mapInArrow(run, "part string, path string, n_rows long, ids_sha256 string")


def cobucket(parents: DataFrame, children: DataFrame, key: str, starts: tuple[tuple[Column, int], tuple[Column, int]], root: str, names: tuple[str, str] = ("parents", "children"), buckets: int = BUCKETS) -> DataFrame:
    """Write both tables in starting files under ``root`` (``starts``: the file's number and how many there are, for each) and bring them to buckets.

    Returns a row for each final file: table_name, path, columns, bucket, n_rows, n_joined, rewritten, lineage, ids_sha256.
    """
    spark = parents.sparkSession
    keys = key_counts(parents, children, key, buckets)
    lone = keys.where("parents = 0").limit(1).count() > 0
    joined = keys.groupBy("bucket").agg(F.sum(F.col("parents") * F.col("children")).alias("n_joined"))
    out = None
    for name, df, (number, files), needs in ((names[0], parents, starts[0], False), (names[1], children, starts[1], lone)):
        folder = Folder(spark, f"{root}/{name}", df)
        write_start(df, key, number, folder.path, files)
        bucket = fresh([*df.columns, folder.part], "bucket")
        matrix = contingency(with_bucket(folder.read(folder.parts()).select(key, folder.part), key, bucket, keys if needs else None, buckets), folder.part, bucket)
        made = rewrite(folder, key, matrix, keys if needs else None, buckets)
        final = made.withColumn("part", F.when(F.col("kept").isNotNull(), F.concat(F.lit("s"), F.col("kept"))).otherwise(F.concat(F.lit("b"), F.col("bucket")))).drop("n_rows")
        rows = facts(folder, key).join(final, "part").join(joined, "bucket", "left").select(
            F.lit(name).alias("table_name"), "path", F.lit(",".join(df.columns)).alias("columns"), F.col("bucket").cast("long"), "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), F.col("kept").isNull().alias("rewritten"), "lineage", "ids_sha256"
        )
        out = rows if out is None else out.unionByName(rows)
    result = persist_table(out, "cobucket-files")
    drop_tables(keys)
    return result


def op13_cobucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    b = own_bucket(F.col("sale_id"), BUCKETS)
    starts = ((F.when(b % 3 == 1, b - 1).otherwise(b), BUCKETS + 2), (F.coalesce(decimal_crc(F.col("item_id"), "", BUCKETS), F.lit(0)), BUCKETS))
    files = cobucket(sales, lines, "sale_id", starts, f"{shared_dir(spark)}/ledgerloom/cobucket-{uuid.uuid4().hex}", ("sales", "sale_lines"))
    return files.select("table_name", "path", "columns", "bucket", "n_rows", "n_joined", "rewritten", F.sha2(F.array_join("lineage", ","), 256).alias("lineage_sha256"), "ids_sha256")
