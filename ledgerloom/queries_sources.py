"""Queries of pinned versions and of names in texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import artifacts, gazetteer
from .queries import query
from .sources import pins
from .sources.stored import shared_folder
from .sources.tables import load

SALES = ["sale_id", "client_id", "status", "total", "sold_at"]


def retained(s, d):
    """Two states of the same sales, of a table that keeps four months."""
    sales = load(s, d, "sales", [*SALES, "arrived_at"])
    return sales.where("arrived_at < '2024-05-01'").select(*SALES), sales.where("arrived_at >= '2024-02-01'").select(*SALES)


@query(f"""WITH x AS (SELECT {', '.join(SALES)}, count(*) FILTER (arrived_at < '2024-05-01') AS was, count(*) FILTER (arrived_at >= '2024-02-01') AS now FROM sales GROUP BY ALL),
 k AS (SELECT sale_id, sum(greatest(was - now, 0))::BIGINT AS n_lost, sum(greatest(now - was, 0))::BIGINT AS n_gained, bool_or(was = 0) AS fresh FROM x WHERE was <> now GROUP BY 1)
 SELECT sale_id, CASE WHEN n_lost > 0 AND n_gained > 0 THEN 'changed' WHEN n_lost > 0 THEN 'lost' WHEN fresh THEN 'added' ELSE 'doubled' END AS change, n_lost, n_gained FROM k""")
def s_located_changes(s, d):
    """Which sales changed, went, came or doubled between two states, from the rows' digests."""
    was, now = retained(s, d)
    return pins.located(pins.row_pins(was, ["sale_id"]), pins.row_pins(now, ["sale_id"]), ["sale_id"])


@query()
def s_versions(s, d):
    """The same states published one after the other in a new folder and compared by their trees; the rows are those of ``s_located_changes``."""
    path = f"{shared_folder(s)}/ledgerloom/versions-{uuid.uuid4().hex}"
    for state in retained(s, d):
        pins.publish_version(state, path, ["sale_id"])
    return pins.compare_versions(s, path, 1, 2)


@query("""WITH words AS (SELECT DISTINCT split_part(text, ' ', 2) AS name FROM benchmark), names AS (SELECT lower(name) AS form, min(name) AS name FROM words WHERE regexp_full_match(name, '[A-Za-z]+') GROUP BY 1),
 said AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(strip_accents(regexp_replace(replace(text, '&', ' and '), '([À-ÅÇ-ÏÑ-ÖÙ-Ýà-åç-ïñ-öù-ýÿ])', '\\1 ', 'g'))), '[^\\p{L}\\p{N}_]+')) AS form FROM documents),
 found AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM said JOIN names USING (form) GROUP BY 1)
 SELECT doc_id, coalesce(names, '') AS names FROM documents LEFT JOIN found USING (doc_id)""")
def f_names_in_documents(s, d):
    """Names of a table (second words of the benchmark's items) in whole documents."""
    names = load(s, d, "benchmark", ["text"]).select(F.get(F.split("text", " "), F.lit(1)).alias("name")).where(F.col("name").rlike("^[A-Za-z]+$"))
    return gazetteer.named_in(load(s, d, "documents", ["doc_id", "text"]), "text", names, "name").select("doc_id", F.array_join("names", ",").alias("names"))


@query()
def f_phrases_in_documents(s, d):
    """Names of two to four words that overlap and lie inside each other: openings of documents in whole documents."""
    docs = load(s, d, "documents", ["doc_id", "text"])
    words = F.split("text", r"\s+", 5)
    openings = docs.select(F.explode(F.array(*[F.array_join(F.slice(words, 1, n), " ") for n in (2, 3, 4)])).alias("name"))
    return gazetteer.named_in(docs, "text", openings, "name").select("doc_id", F.size("names").alias("n_names"), F.sha2(F.array_join("names", ","), 256).alias("names_sha256"))


# A client's record stands for a registered file, its change log for files that came later.


@query("""WITH r AS (SELECT DISTINCT client_id::VARCHAR AS artifact_id, source || '/' || client_id AS path, coalesce(segment, 'none') AS kind, sha256(name) AS sha256 FROM clients WHERE client_id IS NOT NULL AND source IS NOT NULL AND name IS NOT NULL),
 p AS (SELECT path, count(*) AS n, bool_or(many) AS many, min(artifact_id) AS id, min(kind) AS kind, min(sha256) AS want FROM (SELECT *, count(*) OVER (PARTITION BY artifact_id) > 1 AS many FROM r) GROUP BY 1),
 f AS (SELECT source || '/' || client_id AS path, sha256(CASE WHEN balance < 0 THEN email ELSE name END) AS sha256 FROM clients UNION ALL SELECT source || '/' || client_id, sha256(city) FROM client_changes),
 s AS (SELECT f.path, id, kind, CASE WHEN n IS NULL THEN 'unregistered' WHEN n > 1 OR many THEN 'conflicting' WHEN sha256 IS NOT DISTINCT FROM want THEN 'registered' ELSE 'altered' END AS state FROM f LEFT JOIN p ON f.path = p.path)
 SELECT path, CASE WHEN state = 'registered' THEN id END AS artifact_id, CASE WHEN state = 'registered' THEN kind END AS kind, state FROM s""")
def g_artifact_classes(s, d):
    """Files by registered path and content; paths come with detours, which change nothing."""
    clients = load(s, d, "clients", ["client_id", "source", "name", "segment", "email", "balance"])
    path, file = F.concat_ws("/", "source", "client_id"), lambda sha: (F.when(F.col("source").isNotNull() & F.col("client_id").isNotNull(), F.concat(F.lit("x/.././"), "source", F.lit("//"), F.col("client_id").cast("string"))).alias("path"), F.sha2(sha, 256).alias("sha256"))
    known = clients.dropna(subset=["client_id", "source", "name"]).select(F.col("client_id").cast("string").alias("artifact_id"), path.alias("path"), F.coalesce("segment", F.lit("none")).alias("kind"), F.sha2("name", 256).alias("sha256"))
    files = clients.select(*file(F.when(F.col("balance") < 0, F.col("email")).otherwise(F.col("name")))).unionByName(load(s, d, "client_changes", ["client_id", "source", "city"]).select(*file(F.col("city"))))
    return artifacts.classified(files, artifacts.registrations(known))
