"""Queries of identity groups, group splits and graded tables of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import batch, identity
from .queries import query
from .sources.stored import stored
from .sources.tables import load

# The detection key and the tokens in SQL; names hold no letters that fold to several.
LEGAL = "inc|incorporated|corp|corporation|co|company|llc|lp|llp|ltd|limited|plc|gmbh|ag|sa|nv|bv|holdings|holding|group|usa|us|america|americas|na|northamerica"
CUT = f"(^| )(({LEGAL})( |$))+$"
WORDS = "list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
NAMES = f"""WITH RECURSIVE names AS (SELECT DISTINCT name FROM clients WHERE name IS NOT NULL),
 plain AS (SELECT name, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '{CUT}', '')) AS k, {WORDS} AS w FROM names),
 keyed AS (SELECT name, w, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(k, 'north america$', '')), 'north american$', '')), '{CUT}', '')) AS key FROM plain),
 held AS (SELECT 'suffix_key' AS sweep, key AS hub, name FROM keyed UNION ALL SELECT 'first_token', w[1], name FROM keyed WHERE len(w) > 0
  UNION ALL SELECT 'token_prefix', hub, name FROM (SELECT name, unnest([array_to_string(w[1:i], ' ') FOR i IN range(1, len(w) + 1)]) AS hub FROM keyed) WHERE hub IN (SELECT array_to_string(w, ' ') FROM keyed)),
 cand AS (SELECT sweep, hub, name FROM held QUALIFY count(*) OVER (PARTITION BY sweep, hub) > 1) """
REACH = """, link AS (SELECT DISTINCT a.name AS a, b.name AS b FROM cand a JOIN cand b USING (sweep, hub) WHERE sweep <> 'first_token'),
 reach AS (SELECT name AS a, name AS b FROM names UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
 grp AS (SELECT a AS name, min(b) AS split_group FROM reach GROUP BY 1) """


def groups(s, d):
    names = identity.names_of(load(s, d, "clients", ["name"]), "name")
    return identity.identity_groups(names, identity.collision_candidates(names, ("suffix_key", "token_prefix"))).withColumnRenamed("group", "split_group")


@query(NAMES + "SELECT sweep, hub, name FROM cand")
def j_collision_candidates(s, d):
    """Clients whose names may be one identity, by three of the sweeps (the fourth, by spelling, has no SQL)."""
    return identity.collision_candidates(identity.names_of(load(s, d, "clients", ["name"]), "name"), ("suffix_key", "first_token", "token_prefix"))


@query(NAMES + REACH + "SELECT name, split_group FROM grp")
def w_identity_groups(s, d):
    return groups(s, d)


@query()
def w_identity_groups_by_spelling(s, d):
    """Groups by all four sweeps but the first token, which reviewers get as candidates only."""
    names = identity.names_of(load(s, d, "clients", ["name"]), "name")
    return identity.identity_groups(names, identity.collision_candidates(names, ("suffix_key", "token_prefix", "ratio")))


@query(NAMES + f""", looked AS (SELECT DISTINCT 'approved' AS kind, master_id AS label, name FROM clients WHERE master_id % 2 = 0 AND name IS NOT NULL UNION SELECT DISTINCT 'reviewed', master_id, name FROM clients WHERE master_id % 4 = 1 AND name IS NOT NULL),
 size AS (SELECT sweep, hub, count(*) AS n FROM cand GROUP BY 1, 2), sets AS (SELECT kind, label, count(*) AS of_ FROM looked GROUP BY 1, 2),
 best AS (SELECT sweep, hub, min(CASE kind WHEN 'approved' THEN 0 ELSE 1 END + CASE WHEN of_ = held THEN 0 ELSE 2 END) AS r FROM
  (SELECT sweep, hub, kind, label, count(*) AS held FROM cand JOIN looked USING (name) GROUP BY ALL) JOIN sets USING (kind, label) JOIN size USING (sweep, hub) WHERE held = n GROUP BY 1, 2)
 SELECT sweep, hub, n, coalesce((['approved', 'reviewed', 'approved_subset', 'reviewed_subset'])[r + 1], 'unmapped') AS disposition FROM size LEFT JOIN best USING (sweep, hub)""")
def j_collision_review(s, d):
    """Candidates against sets that were looked at: clients with one master record, approved or turned down by its number."""
    clients = load(s, d, "clients", ["master_id", "name"]).where("name is not null").withColumnRenamed("master_id", "label")
    found = identity.collision_candidates(identity.names_of(clients, "name"), ("suffix_key", "first_token", "token_prefix"))
    return identity.dispositions(found, clients.where("label % 2 = 0"), clients.where("label % 4 = 1"))


SPLIT = NAMES + REACH + """, forced AS (SELECT DISTINCT split_group FROM grp WHERE name IN (SELECT name FROM vendors)),
 own AS (SELECT client_id, name, segment, split_group FROM clients LEFT JOIN grp USING (name)),
 ranked AS (SELECT split_group, row_number() OVER (PARTITION BY stratum ORDER BY md5('holdout-1:' || split_group), split_group) AS r, count(*) OVER (PARTITION BY stratum) AS n
  FROM (SELECT split_group, arg_min_null(segment, client_id) AS stratum FROM own WHERE split_group IS NOT NULL AND split_group NOT IN (FROM forced) GROUP BY 1)),
 done AS (SELECT client_id, name, split_group, coalesce(CASE WHEN r <= round_even(n * 0.1, 0) THEN 'dev' WHEN r <= round_even(n * 0.1, 0) + round_even(n * 0.2, 0) THEN 'test' END, 'train') AS split, coalesce(split_group IN (FROM forced), false) AS held_in
  FROM own LEFT JOIN ranked USING (split_group)) """


def group_split(s, d):
    found = stored(groups(s, d), "identity-groups")
    rows = load(s, d, "clients", ["client_id", "name", "segment"]).join(found.hint("merge"), "name", "left")
    vendors = identity.referenced_names(found, load(s, d, "vendors", ["name"]), "name")
    return identity.assign_group_splits(rows, "client_id", "split_group", "segment", "holdout-1:", vendors)


@query(SPLIT + "SELECT client_id, split_group, split, held_in FROM done")
def w_group_split(s, d):
    """Clients split by identity groups within segments; groups that a vendor's name is in are held in training."""
    return group_split(s, d).select("client_id", "split_group", "split", "held_in")


@query(SPLIT + """SELECT (SELECT count(*) FROM (SELECT name FROM done WHERE name IS NOT NULL GROUP BY 1 HAVING min(split) <> max(split))) AS names_apart, (SELECT count(*) FROM (SELECT split_group FROM done WHERE split_group IS NOT NULL GROUP BY 1 HAVING min(split) <> max(split))) AS groups_apart,
 (SELECT count(*) FROM (SELECT client_id FROM done GROUP BY 1 HAVING count(*) > 1)) AS repeated_rows, (SELECT count(*) FROM done WHERE held_in AND split <> 'train') AS misplaced, (SELECT 3 - count(DISTINCT split) FROM done) AS empty_splits""")
def a_split_checks(s, d):
    return identity.split_checks(stored(group_split(s, d), "identity-split"), "name", "split_group", "client_id")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def predicted_sql(s, d):
    """Items and predictions, one for each customer: three kinds of questions on the own segment, seven kinds of predictions."""
    c = load(s, d, "customer", ["c_custkey", "c_mktsegment"])
    next_ = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(SEGMENTS) for x in (g, SEGMENTS[(i + 1) % 5])]), F.col("c_mktsegment"))
    ask = {
        "scalar": ("n", "SELECT count(*) AS n FROM customer WHERE c_mktsegment = '{}'", "SELECT COUNT(1) AS total FROM customer c WHERE ('{}' = c.c_mktsegment)"),
        "set": ("c_nationkey", "SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = '{}'", "SELECT c_nationkey, max(c_acctbal) AS top FROM customer WHERE c_mktsegment = '{}' GROUP BY c_nationkey"),
        "top_k": ("c_custkey", "SELECT c_custkey FROM customer WHERE c_mktsegment = '{}' ORDER BY c_acctbal DESC, c_custkey LIMIT 20", "SELECT c_custkey FROM customer WHERE c_mktsegment = '{}' ORDER BY c_acctbal, c_custkey LIMIT 20"),
    }
    filled = lambda sql, seg: F.concat(F.lit(sql.split("{}")[0]), seg, F.lit(sql.split("{}")[1]))
    by_kind = lambda make: F.element_at(F.array(*[make(k, *v) for k, v in ask.items()]), (F.col("c_custkey") % 3 + 1).cast("int"))
    gold = by_kind(lambda k, t, g, o: filled(g, F.col("c_mktsegment")))
    said = [gold, by_kind(lambda k, t, g, o: filled(o, F.col("c_mktsegment"))), by_kind(lambda k, t, g, o: filled(g, next_)), F.lit("SELECT nothing FROM customer"), F.lit("There are many."), F.lit(" "), F.lit("SELECT c_custkey FROM customer LIMIT 1 OFFSET 0")]
    item = F.to_json(F.struct(by_kind(lambda k, t, g, o: F.lit(k)).alias("answer_type"), F.array(by_kind(lambda k, t, g, o: F.lit(t))).alias("target_columns"), gold.alias("gold_sql")))
    k = F.floor(F.col("c_custkey") / 3) % 7
    return c.select("c_custkey", item.alias("item"), F.element_at(F.array(*said), (k + 1).cast("int")).alias("said"), (F.col("c_custkey") % 50 == 0).alias("cut"))


@query("""WITH x AS (SELECT *, (c_custkey // 3) % 7 AS f, ['scalar', 'set', 'top_k'][c_custkey % 3 + 1] AS kind, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE'])[list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) + 1] AS nxt FROM customer),
 s AS (SELECT c_mktsegment AS seg, count(*) AS n, list_sort(list(DISTINCT c_nationkey)) AS nations, list(c_custkey ORDER BY c_acctbal DESC, c_custkey)[1:20] AS top, list(c_custkey ORDER BY c_acctbal, c_custkey)[1:20] AS low FROM customer GROUP BY 1)
 SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'truncated_output' WHEN f = 3 THEN 'SQL_error' WHEN f = 4 THEN 'parse_failure' WHEN f = 5 THEN 'generation_failure' WHEN f = 6 THEN 'incorrect' WHEN f = 0 THEN 'correct'
   WHEN f = 1 THEN CASE WHEN kind <> 'top_k' OR a.top = a.low THEN 'correct' ELSE 'incorrect' END WHEN CASE kind WHEN 'scalar' THEN a.n = b.n WHEN 'set' THEN a.nations = b.nations ELSE a.top = b.top END THEN 'correct' ELSE 'incorrect' END AS status,
  c_custkey % 50 <> 0 AND (f IN (0, 2) OR (kind = 'top_k' AND f IN (1, 6))) AS strict FROM x JOIN s a ON a.seg = c_mktsegment JOIN s b ON b.seg = nxt""")
def g_graded_sql(s, d):
    """A table of SQL predictions against their gold statements; whatever is asked twice runs once."""
    x = predicted_sql(s, d)
    scopes = {"all": {"customer": load(s, d, "customer")}}
    return batch.graded_sql(s, scopes, x.select("c_custkey", "item"), x.select("c_custkey", "said", "cut"), "c_custkey", "item", "said", "all", "cut", seconds=120.0).select("c_custkey", "status", "strict")


@query("""WITH s AS (SELECT count(*) FILTER (c_mktsegment = 'BUILDING') AS n FROM customer), x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 4 = 0 ELSE c_custkey % 3 = 0 END AS ok, c_custkey % 2 = 1 AND c_custkey % 5 = 0 AS none FROM customer)
 SELECT coalesce(c_mktsegment, 'ALL') AS family, count(*) AS n, count(*) FILTER (ok) AS correct, 0 AS failed, count(*) FILTER (none) AS no_match, count(*) FILTER (none AND ok) AS valid_no_match FROM x GROUP BY ROLLUP (c_mktsegment)""")
def g_final_summary(s, d):
    """A run with SQL items and answers beside them, by families, with the items that nothing matches."""
    c = load(s, d, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    k, even = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    sql = F.lit("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
    gold = F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("c_name"))
    item = F.when(even, F.to_json(F.struct(F.lit("scalar").alias("answer_type"), F.array(F.lit("n")).alias("target_columns"), sql.alias("gold_sql")))).otherwise(F.to_json(F.struct(F.lit("set").alias("answer_type"), gold.alias("gold_value"))))
    said = F.when(even, F.when(k % 4 == 0, sql).otherwise("SELECT -1 AS n")).otherwise(F.when(k % 3 == 0, F.to_json(gold)).otherwise('["nobody"]'))
    x = c.select("c_custkey", item.alias("item"), said.alias("said"), F.col("c_mktsegment").alias("family"), F.lit(7).alias("seed"))
    graded = batch.final_run(s, {"all": {"customer": load(s, d, "customer")}}, x.select("c_custkey", "item", "seed"), x.select("c_custkey", "said", "seed"), "c_custkey", "item", "said", "all", ("seed",), seconds=120.0)
    return batch.run_summary(graded, x, "c_custkey", "item", "family").withColumn("family", F.coalesce("family", F.lit("ALL")))
