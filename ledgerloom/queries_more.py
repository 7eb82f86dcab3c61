"""Further queries of the engine's own operators: records and answers, task pools, token operators, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import sqltext, text as tx
from .operators import answers, chat, literals, records, relational as rel, stats, tasks
from .queries import ITEMS, SCOPED, items, judged, n_rows, query, r6, splits
from .sources import tables
from .sources.tables import load

JUDGED = "(SELECT doc_id, lang, source, quality, toxic, CASE WHEN toxic = 1 THEN 'timeout' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS status FROM documents JOIN labels USING (doc_id))"

# Sources


@query("SELECT DISTINCT p_partkey, p_brand, unnest([p_name, p_type]) AS term FROM part WHERE p_size >= 5")
def s_child_table(s, d):
    held = F.when(F.col("p_size") < 5, "None identified after search").otherwise(F.concat_ws("; ", "p_name", "p_type"))
    return tables.build_tables(load(s, d, "part").withColumn("terms", held), "p_partkey", "p_brand", {"terms": "terms"})["terms"]


@query("SELECT c_custkey, unnest([0, 1]) AS seq, unnest([c_acctbal, NULL]) AS loss, unnest([c_custkey::DOUBLE, c_nationkey::DOUBLE]) AS step FROM customer")
def s_log_scan(s, d):
    """Dict literals between progress bars; one without a known key is no record."""
    log = F.concat(F.lit("  3%|# | {'loss': "), F.col("c_acctbal").cast("string"), F.lit(", 'step': "), F.col("c_custkey").cast("string"), F.lit("}\n{'other': 1}\n100%|####| {\"step\": '"), F.col("c_nationkey").cast("string"), F.lit("'}"))
    return tables.scan_log(load(s, d, "customer").select("c_custkey", log.alias("log")), "log", ["loss", "step"])


# Policy and joins


@query("SELECT event_id FROM events WHERE (event_type = 'view' AND user_id % 3 IN (0, 1)) OR (event_type = 'click' AND user_id % 3 = 0) OR (event_type = 'purchase' AND user_id % 3 = 2)")
def p_field_policy(s, d):
    policy = tasks.FieldPolicy({"view": {"filter", "group_by"}, "click": {"filter", "group_by"}, "purchase": {"argmax"}}, {"click": {"group_by"}})
    op = F.when(F.col("user_id") % 3 == 0, "filter").when(F.col("user_id") % 3 == 1, "group_by").otherwise("argmax")
    return policy.filter(load(s, d, "events", ["event_id", "event_type", "user_id"]).withColumn("op", op), "event_type", "op").select("event_id")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1")
def j_asserted(s, d):
    o = load(s, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return records.asserted_join(o.where("o_orderkey % 3 = 0"), o.select("o_orderkey", "o_custkey"), "o_orderkey", ["o_custkey"]).groupBy("o_orderstatus").agg(n_rows())


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 1) AS only_a, 0 AS only_b, 0 AS repeated, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey % 7 = 0 AND o_orderpriority <> '5-LOW') AS differ_o_orderpriority, 0 AS differ_o_orderstatus")
def j_paired(s, d):
    a = load(s, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    b = a.where("o_orderkey % 10 <> 1").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "5-LOW").otherwise(F.col("o_orderpriority")))
    return records.paired(a, b, "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query("SELECT doc_id, quality AS original, toxic AS other FROM labels WHERE doc_id % 3 <> 0 AND quality <> toxic")
def j_score_changes(s, d):
    x = load(s, d, "labels")
    a = x.select("doc_id", F.lit("original").alias("kind"), F.lit(0).alias("gold"), F.col("quality").alias("score"))
    b = x.select("doc_id", F.lit("paraphrase").alias("kind"), F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("gold"), F.col("toxic").alias("score"))
    return records.score_changes(a.union(b), ["doc_id"], "kind", "original", "paraphrase", "gold", "score")


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR (o_orderkey % 11 = 0 AND c_mktsegment <> 'BUILDING')")
def j_unfaithful_copies(s, d):
    c = load(s, d, "customer", ["c_custkey", "c_mktsegment"])
    copies = load(s, d, "orders", ["o_orderkey", "o_custkey"]).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("c_mktsegment", F.when(F.col("o_orderkey") % 11 == 0, "BUILDING").otherwise(F.col("c_mktsegment")))
    return records.unfaithful_copies(copies.select("o_orderkey", "o_custkey", "c_mktsegment"), c, "o_custkey", "c_custkey", "c_mktsegment").select("o_orderkey")


# Aggregates


CHILDREN = f"(SELECT o_custkey, split, field, term FROM (SELECT o_custkey, unnest(['brand', 'type', 'urgent']) AS field, unnest([p_brand, p_type, CASE WHEN o_custkey % 3 = 0 THEN 'yes' END]) AS term FROM ({ITEMS})) JOIN scoped ON c_custkey = o_custkey WHERE term IS NOT NULL)"


def children(s, d):
    """(o_custkey, split, field, term): what customers' orders hold, with the customer's split."""
    x = items(s, d).withColumn("urgent", F.when(F.col("o_custkey") % 3 == 0, "yes")).select("o_custkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "urgent")
    long = x.unpivot("o_custkey", ["brand", "type", "urgent"], "field", "term").where("term is not null")
    return long.join(splits(s, d).select(F.col("c_custkey").alias("o_custkey"), "split"), "o_custkey")


@query(SCOPED + f"SELECT field, count(DISTINCT term) AS n_rows, count(DISTINCT o_custkey) AS n_entities FROM {CHILDREN} WHERE split = 'train' GROUP BY 1")
def a_attribute_totals(s, d):
    return tasks.attribute_totals(children(s, d), "o_custkey", "term", "split", "field")


@query(SCOPED + f"""SELECT a, b, train, test FROM (SELECT x.field AS a, y.field AS b, count(DISTINCT x.o_custkey) FILTER (x.split = 'train') AS train, count(DISTINCT x.o_custkey) FILTER (x.split = 'test') AS test
 FROM (SELECT DISTINCT o_custkey, split, field FROM {CHILDREN}) x JOIN (SELECT DISTINCT o_custkey, field FROM {CHILDREN}) y ON x.o_custkey = y.o_custkey AND x.field < y.field GROUP BY 1, 2) WHERE train >= 1 AND test >= 1 ORDER BY train, a, b LIMIT 1""")
def a_rarest_pair(s, d):
    return tasks.rarest_pair(children(s, d), "o_custkey", "field", "split", [("brand", "type"), ("urgent", "type"), ("brand", "urgent")])


@query(SCOPED + "SELECT term, CASE WHEN count(*) FILTER (split = 'train') > 0 THEN 'seen' ELSE 'held_out_only' END AS exposure FROM (SELECT floor(c_acctbal / 10)::BIGINT::VARCHAR AS term, split FROM customer JOIN scoped USING (c_custkey)) GROUP BY 1")
def a_value_exposure(s, d):
    """Balances by tens: some are held by customers outside training only."""
    x = load(s, d, "customer", ["c_custkey", "c_acctbal"]).join(splits(s, d).select("c_custkey", "split"), "c_custkey")
    return tasks.value_exposure(x.select(F.floor(F.col("c_acctbal") / 10).cast("long").cast("string").alias("term"), "split"), "term", "split")


@query("SELECT b, c, round(least(1.0, 2 * list_sum([exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)) FOR i IN range(0, least(b, c) + 1)])), 6) AS p FROM (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS b, count(*) FILTER (quality = 0 AND toxic = 1) AS c FROM labels)")
def a_mcnemar(s, d):
    q, t = F.col("quality"), F.col("toxic")
    counts = load(s, d, "labels").agg(F.count_if((q == 1) & (t == 0)).alias("b"), F.count_if((q == 0) & (t == 1)).alias("c"))
    return counts.select("b", "c", r6(stats.mcnemar_p("b", "c")).alias("p"))


@query("SELECT seed, count(*) AS n, round(avg(((c_custkey + seed) % 3 = 0)::INT), 6) AS mean FROM (SELECT c_custkey, unnest([1, 2, 5]) AS seed FROM customer) GROUP BY 1")
def a_seed_scores(s, d):
    x = load(s, d, "customer", ["c_custkey"]).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5)))).withColumn("score", ((F.col("c_custkey") + F.col("seed")) % 3 == 0).cast("int"))
    return records.seed_scores(x, "seed", "c_custkey", "score").withColumn("mean", r6(F.col("mean")))


@query("SELECT count(*) FILTER (doc_id % 5 < 3) AS recomputed, count(*) FILTER (doc_id % 5 = 3) AS insufficient_evidence, count(*) FILTER (doc_id % 5 = 4) AS not_yet, count(*) AS total FROM documents")
def a_regrade_coverage(s, d):
    k = F.col("doc_id") % 5
    return records.regrade_coverage(load(s, d, "documents", ["doc_id"]).withColumn("o", F.when(k < 3, "recomputed").when(k == 3, "insufficient_evidence")), "o")


@query("SELECT c_nationkey, l[(len(l) // 4 + 1)::INT] AS q1, l[(len(l) // 2 + 1)::INT] AS q2, l[(3 * len(l) // 4 + 1)::INT] AS q3 FROM (SELECT c_nationkey, list_sort(list(c_acctbal)) AS l FROM customer GROUP BY 1)")
def a_quartiles(s, d):
    return stats.at_ranks(load(s, d, "customer", ["c_nationkey", "c_acctbal"]), "c_acctbal", {"q1": (1, 4), "q2": (1, 2), "q3": (3, 4)}, "c_nationkey").drop("low", "high")


@query(f"SELECT lang, dimension, value, count(*) AS n, count(quality) AS scored_n, sum(quality)::DOUBLE AS correct_sum, count(*) FILTER (status = 'SQL_error') AS sql_errors FROM (SELECT lang, quality, replace(status, 'timeout', 'SQL_error') AS status, unnest(['source', 'toxic']) AS dimension, unnest([source, toxic::VARCHAR]) AS value FROM {JUDGED}) GROUP BY 1, 2, 3")
def a_census(s, d):
    x = judged(s, d).withColumn("status", F.replace("status", F.lit("timeout"), F.lit("SQL_error")))
    return records.census(x, ["source", "toxic"], ["lang"], "quality", "status")


@query("SELECT l_returnflag AS kind, count(*) AS total, count(*) FILTER (l_quantity > 25) AS correct, count(*) FILTER (l_linestatus = 'F') AS empty FROM lineitem GROUP BY 1")
def a_part_counters(s, d):
    x = load(s, d, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity", "l_linestatus"])
    part = F.struct(F.col("l_returnflag").alias("kind"), (F.col("l_quantity") > 25).alias("correct"), F.when(F.col("l_linestatus") != "F", "x").otherwise(" ").alias("output"))
    return records.part_counters(x.groupBy("l_orderkey").agg(F.collect_list(part).alias("parts")), "parts")


@query("SELECT (SELECT count(*) FROM (SELECT c_custkey, unnest(['F', 'O']) AS st FROM customer EXCEPT SELECT o_custkey, o_orderstatus FROM orders)) AS missing, (SELECT count(*) FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT SELECT c_custkey, unnest(['F', 'O']) FROM customer)) AS extra")
def a_coverage(s, d):
    need = load(s, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("st"))
    return records.coverage(load(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("st")), need, ["k", "st"])


@query("SELECT count(*) FILTER (g = 0) AS n, count(*) FILTER (g = 0 AND p = 0) AS valid, count(*) FILTER (g = 0 AND p > 0) AS invented, count(*) FILTER (g > 0 AND p = 0) AS wrongly_empty FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS g, count(*) FILTER (o_orderpriority = '1-URGENT') AS p FROM orders GROUP BY o_custkey)")
def a_no_match(s, d):
    x = load(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("g"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("p"))
    return records.no_match(x, F.col("g"), F.col("p"), F.col("p") == 0)


# Windows and sets


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r > (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey))")
def w_extra_copies(s, d):
    return rel.extra_copies(load(s, d, "orders", ["o_orderkey", "o_custkey"]), "o_custkey", "o_orderkey").select("o_orderkey")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('c' || p_partkey), p_partkey) <= 40")
def w_capped(s, d):
    return rel.capped(load(s, d, "part", ["p_brand", "p_partkey"]), "p_brand", 40, F.md5(F.concat(F.lit("c"), F.col("p_partkey").cast("string"))), "p_partkey")


@query("SELECT c_mktsegment, o_custkey, matched FROM (SELECT c_mktsegment, o_custkey, count(*) FILTER (o_orderstatus = 'F') AS matched FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY matched = 1, matched DESC, o_custkey) <= 25")
def w_preferred(s, d):
    c = load(s, d, "customer", ["c_custkey", "c_mktsegment"])
    x = load(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("matched"))
    return rel.preferred(x, "c_mktsegment", "matched", 25, "o_custkey")


@query("""WITH p AS (SELECT DISTINCT p_name AS term, l_suppkey AS e FROM lineitem JOIN part ON p_partkey = l_partkey), t AS (SELECT term FROM p GROUP BY 1 HAVING count(*) >= 2 ORDER BY 1 LIMIT 8)
 SELECT term, (SELECT array_to_string(list_sort(list(e))[1:2], ',') FROM p WHERE p.term = t.term) AS matches, (SELECT min(e) FROM (SELECT DISTINCT e FROM p) a WHERE e NOT IN (SELECT e FROM p WHERE p.term = t.term)) AS other FROM t""")
def w_evidence_sets(s, d):
    x = load(s, d, "lineitem", ["l_partkey", "l_suppkey"]).join(load(s, d, "part", ["p_partkey", "p_name"]), F.col("p_partkey") == F.col("l_partkey"))
    return rel.evidence_sets(x.select(F.col("p_name").alias("term"), F.col("l_suppkey").alias("e")), "term", "e").withColumn("matches", F.array_join("matches", ","))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i IN (SELECT round_even(k * (n - 1) / 24.0, 0) FROM (SELECT unnest(range(25)) AS k, (SELECT count(*) FROM orders) AS n))")
def w_spread(s, d):
    return rel.spread(load(s, d, "orders", ["o_orderkey"]), 25, "o_orderkey")


@query("SELECT held, count(*) FILTER (hit) AS n, count(*) AS scanned FROM (SELECT held, k, bool_and(list_contains(used, c)) AS hit FROM (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS used FROM orders GROUP BY 1), (SELECT h AS held, unnest(string_split(h, '+')) AS c FROM (VALUES ('1-URGENT+2-HIGH'), ('1-URGENT+2-HIGH+3-MEDIUM+4-NOT SPECIFIED+5-LOW')) v(h)) GROUP BY held, k) GROUP BY 1")
def u_superset(s, d):
    held = [["2-HIGH", "1-URGENT"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]]
    return tasks.composition_exposure(load(s, d, "orders", ["o_custkey", "o_orderpriority"]), "o_custkey", "o_orderpriority", held)


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus) || list(o_orderpriority))), ',') AS components FROM orders GROUP BY 1")
def u_part_union(s, d):
    x = load(s, d, "orders").select("o_custkey", F.array("o_orderstatus", "o_orderpriority").alias("c"))
    return tasks.part_union(x, "o_custkey", "c").withColumn("components", F.array_join("components", ","))


@query("SELECT count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def u_shared_keys(s, d):
    o = load(s, d, "orders", ["o_custkey", "o_orderstatus"])
    return rel.shared_keys(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_custkey")


# Text


@query("SELECT item_id, count(*) AS n_docs FROM benchmark JOIN documents ON contains(documents.text, benchmark.text) WHERE length(benchmark.text) > 0 GROUP BY 1")
def f_leaks(s, d):
    """Benchmark texts that stand in documents as they are."""
    return literals.exposed(load(s, d, "documents", ["text"]), "text", load(s, d, "benchmark"), "item_id", "text", exact=True)


@query("SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 ELSE 2 END AS n, CASE WHEN p_size >= 5 THEN p_name END AS first FROM part")
def f_stored_terms(s, d):
    raw = F.when(F.col("p_size") < 5, "None identified after search").otherwise(F.concat_ws("; ", "p_name", "p_type"))
    t = tx.stored_terms(raw)
    return load(s, d, "part").select("p_partkey", F.size(t).alias("n"), F.try_element_at(t, F.lit(1)).alias("first"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')[1:5], ' ') AS w FROM documents WHERE regexp_full_match(text, '[\\x00-\\x7F]*')")
def f_tokens(s, d):
    x = load(s, d, "documents", ["doc_id", "text"]).where(F.rlike("text", F.lit(r"\A[\x00-\x7F]*\z")))
    return x.select("doc_id", F.array_join(F.slice(tx.tokens(F.col("text")), 1, 5), " ").alias("w"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_name END AS city, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS county FROM customer")
def f_city_county(s, d):
    k, seg = F.col("c_custkey") % 4, F.col("c_mktsegment")
    where = F.when(k == 0, F.concat(F.col("c_name"), F.lit(" ,  "), seg)).when(k == 1, F.concat(F.col("c_name"), F.lit(", County"))).when(k == 2, F.concat_ws(",", "c_name", seg, seg)).otherwise(F.lit("Not specified"))
    city, county = tx.city_county(where)
    return load(s, d, "customer").select("c_custkey", city.alias("city"), county.alias("county"))


@query("SELECT p_partkey, lower(p_name) || ' and ' || lower(p_type) AS plain, lower(p_name) AS short FROM part")
def f_plain(s, d):
    x = F.concat(F.upper("p_name"), F.lit(" & ("), F.col("p_type"), F.lit(") "))
    return load(s, d, "part").select("p_partkey", tx.plain(x).alias("plain"), tx.short_name(F.concat(F.col("p_name"), F.lit(", Inc. Group"))).alias("short"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey WHEN 1 THEN 1000 + c_nationkey END AS claim FROM customer")
def f_count_claim(s, d):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    said = F.when(k == 0, F.concat(F.lit("So there are only "), n, F.lit(" companies."))).when(k == 1, F.concat(F.lit("Well.\n1,0"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit(" matching rows"))).otherwise(F.concat(F.lit("number "), n))
    return load(s, d, "customer").select("c_custkey", tx.count_claim(said).alias("claim"))


@query("SELECT p_partkey, p_size % 3 <> 2 AS by_text, p_size % 3 <> 1 AS by_number FROM part")
def f_value_match(s, d):
    k, size = F.col("p_size") % 3, F.col("p_size").cast("string")
    said = F.when(k == 0, F.concat(F.lit("it is "), F.upper("p_type"), F.lit(" and "), F.col("p_brand"))).when(k == 1, F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_type"))).otherwise(F.lit("none of these"))
    gold = F.concat_ws("; ", "p_brand", "p_type")
    number = F.when(k == 1, F.lit("no 1,000 here")).otherwise(F.concat(F.lit("about "), size, F.lit(".0 of 1,000")))
    return load(s, d, "part").select("p_partkey", tx.value_match(said, gold).alias("by_text"), tx.value_match(number, size, True).alias("by_number"))


@query("SELECT o_custkey, round(i / np, 6) AS precision, round(i / ng, 6) AS recall, round(2 * i / (np + ng), 6) AS f1 FROM (SELECT o_custkey, len(list_intersect(p, g))::DOUBLE AS i, len(p) AS np, len(g) AS ng FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p, list(DISTINCT CASE WHEN o_orderstatus = 'F' THEN '5-LOW' ELSE o_orderpriority END) AS g FROM orders GROUP BY 1))")
def f_set_scores(s, d):
    g = F.when(F.col("o_orderstatus") == "F", "5-LOW").otherwise(F.col("o_orderpriority"))
    x = load(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("p"), F.collect_list(g).alias("g"))
    p, r, f = tx.set_scores(F.col("p"), F.col("g"))
    return x.select("o_custkey", r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN round(4.0 / 5, 6) ELSE 1.0 END AS f1 FROM part")
def f_token_f1(s, d):
    a, b = tx.tokens(F.col("p_name")), tx.tokens(F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(" xyz"))).otherwise(F.col("p_name")))
    return load(s, d, "part").select("p_partkey", r6(tx.token_f1(a, b)).alias("f1"))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'argmax_topk' WHEN 1 THEN 'group_by' WHEN 2 THEN 'limit_only' WHEN 3 THEN 'filter' ELSE 'argmax_topk' END AS family, CASE o_orderkey % 5 WHEN 0 THEN 'argmax_topk' WHEN 1 THEN 'group_by' WHEN 2 THEN 'limit_only' WHEN 3 THEN '' ELSE 'argmax_topk,group_by' END AS families, (o_orderkey % 5 = 1)::INT AS joins FROM orders")
def f_operation_family(s, d):
    sql = F.element_at(F.array(*map(F.lit, ["SELECT a FROM t ORDER/**/BY a LIMIT 3", "SELECT a FROM t JOIN u USING (a) GROUP -- x\n BY a", "SELECT 'order by' FROM t LIMIT 2", "SELECT \"group by\", 'a limit', [join] FROM t /* limit */", "SELECT a, count(*) FROM t GROUP BY a ORDER BY 2 LIMIT 1"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    x = load(s, d, "orders", ["o_orderkey"]).withColumn("sql", sql)
    return x.select("o_orderkey", sqltext.operation_family(F.col("sql")).alias("family"), F.array_join(sqltext.operation_families(F.col("sql")), ",").alias("families"), sqltext.join_arity(F.col("sql")).alias("joins"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'truncated_output' WHEN 1 THEN 'generation_failure' WHEN 2 THEN 'invalid_output' WHEN 3 THEN 'generation_failure' END AS status FROM customer")
def f_degenerate(s, d):
    from .operators.grade import degenerate_status

    k = F.col("c_custkey") % 5
    said = F.when(k == 0, "I'm sorry").when(k == 1, " \n").when(k == 2, "As an AI, I CANNOT say").when(k == 4, F.col("c_name"))
    return load(s, d, "customer").select("c_custkey", degenerate_status(said, k == 0).alias("status"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'filter' ELSE 'none' END AS kind, 'WHERE name = ''it''''s ' || p_name || '''' AS sql, p_brand || ' makes ' || p_name || ' (' || p_size || ').' AS text FROM part")
def f_render(s, d):
    task = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("D_v3_filter_"), F.col("p_brand"))).otherwise(F.col("p_brand"))
    name = F.concat(F.lit("it's "), F.col("p_name"))
    return load(s, d, "part").select("p_partkey", tasks.task_kind(task).alias("kind"), F.concat(F.lit("WHERE name = "), sqltext.sql_literal(name)).alias("sql"), tx.render("{b} makes {n} ({k}).", b=F.col("p_brand"), n=F.col("p_name"), k=F.col("p_size")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'NATION_1,NATION_13' ELSE 'NATION_2' END AS names FROM orders")
def f_names_in(s, d):
    """Longest names first, and names of the question don't count."""
    names = [r[0] for r in load(s, d, "nation", ["n_name"]).collect()]
    said = F.when(F.col("o_orderkey") % 2 == 0, "From Nation_13 to NATION_1, nation_130 aside.").otherwise("nation_2 and nation_24?")
    x = load(s, d, "orders", ["o_orderkey"]).withColumns({"said": said, "asked": F.lit("what of Nation_24")})
    return tx.names_in(x, "said", names, "asked").select("o_orderkey", F.array_join("names", ",").alias("names"))


# Answers


@query("SELECT c_custkey, c_custkey % 6 IN (0, 1) AS is_set, c_custkey % 6 IN (2, 3) AS is_scalar FROM customer")
def n_contract(s, d):
    said = F.element_at(F.array(*map(F.lit, ['["a", 1]', " [] ", '"a"', "12.5", "[NaN]", "null"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    return load(s, d, "customer", ["c_custkey"]).select("c_custkey", answers.contract_column(said, "set").alias("is_set"), answers.contract_column(said, "scalar").alias("is_scalar"))


@query("""SELECT c_custkey, CASE c_custkey % 8 WHEN 3 THEN 'incorrect' WHEN 5 THEN 'parse_failure' WHEN 7 THEN 'invalid_output' ELSE 'correct' END AS status, c_custkey % 8 IN (0, 4) AS strict, c_custkey % 8 IN (0, 2, 3, 4) AS contract,
 CASE c_custkey % 8 WHEN 1 THEN 'named_object_unwrap' WHEN 2 THEN 'surplus_quote_strip' ELSE '' END AS repairs, CASE WHEN c_custkey % 8 = 3 THEN lower(c_mktsegment) ELSE '' END AS missing FROM customer""")
def n_answers(s, d):
    """Graded answers: as asked, under the asked name, overquoted, short of one, in another order, in a broken fence, as a sentence, refused."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    forms = [
        F.concat(F.lit("["), q(name), F.lit(", "), q(seg), F.lit("]")), F.concat(F.lit('{"Company": ['), q(name), F.lit(", "), q(seg), F.lit("]}")), F.concat(F.lit('["\\"'), name, F.lit('\\"", '), q(F.lower(seg)), F.lit("]")),
        F.concat(F.lit("["), q(name), F.lit("]")), F.concat(F.lit("["), q(seg), F.lit(", "), q(name), F.lit("]")), F.concat(F.lit("```json\n["), q(name), F.lit("]")), F.concat(F.lit("The companies are: "), name, F.lit("; "), seg, F.lit(".")), F.lit("I cannot say."),
    ]
    item = F.to_json(F.struct(F.lit("set").alias("answer_type"), F.array(F.lit("company")).alias("target_columns"), F.array(name, seg).alias("gold_value")))
    x = load(s, d, "customer").select("c_custkey", F.element_at(F.array(*forms), (F.col("c_custkey") % 8 + 1).cast("int")).alias("said"), item.alias("item"))
    g = answers.graded_answers(x, "said", "item", wording=answers.Wording(("The companies are:",)))
    return g.select("c_custkey", "graded.status", "graded.strict", "graded.contract", F.array_join("graded.repairs", ",").alias("repairs"), F.coalesce(F.array_join("graded.missing", ","), F.lit("")).alias("missing"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'incorrect' ELSE 'correct' END AS status, c_custkey % 4 IN (0, 3) AS strict, CASE c_custkey % 4 WHEN 1 THEN 1 ELSE 0 END AS duplicates FROM customer")
def n_rows_answers(s, d):
    """Rows of rows as a set under the contract without duplicates: right, one row twice, null as a word, in another order."""
    name = F.col("c_name")
    row = lambda a, b: F.concat(F.lit('["'), a, F.lit('", '), b, F.lit("]"))
    one, two = row(name, F.lit("null")), row(F.col("c_mktsegment"), F.lit("2"))
    forms = [F.concat_ws(", ", one, two), F.concat_ws(", ", one, two, one), F.concat_ws(", ", row(name, F.lit('"null"')), two), F.concat_ws(", ", two, one)]
    said = F.concat(F.lit("["), F.element_at(F.array(*forms), (F.col("c_custkey") % 4 + 1).cast("int")), F.lit("]"))
    item = F.concat(F.lit('{"answer_type": "set", "gold_value": {"columns": ["a", "b"], "rows": ['), one, F.lit(", "), two, F.lit("]}}"))
    g = answers.graded_answers(load(s, d, "customer").select("c_custkey", said.alias("said"), item.alias("item")), "said", "item", unique=True)
    return g.select("c_custkey", "graded.status", "graded.strict", "graded.duplicates")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'correct' ELSE 'incorrect' END AS status FROM customer")
def n_multipart(s, d):
    """Every part counts, and no part more than asked for."""
    bal, name = F.col("c_custkey").cast("string"), F.col("c_name")
    extra = F.when(F.col("c_custkey") % 3 == 1, ', "c": 1').otherwise("")
    number = F.when(F.col("c_custkey") % 3 == 2, "-1").otherwise(bal)
    said = F.concat(F.lit('{"a": '), number, F.lit(', "b": ["'), name, F.lit('"]'), extra, F.lit("}"))
    item = F.concat(F.lit('{"answer_type": "multi_part", "parts": [{"part_id": "a", "answer_type": "scalar"}, {"part_id": "b", "answer_type": "set"}], "gold_value": {"a": '), bal, F.lit(', "b": ["'), name, F.lit('"]}}'))
    return answers.graded_parts(load(s, d, "customer").select("c_custkey", said.alias("said"), item.alias("item")), "c_custkey", "said", "item").select("c_custkey", "status")


SENTENCES = "list_filter([trim(x) FOR x IN string_split_regex(replace(text, chr(10), '. '), '[.;]')], lambda x: x <> '' AND NOT regexp_matches(x, '^[-0-9*•+\"]'))"
FORM = "list_distinct(list_filter([lower(regexp_replace(x, '\\s+', ' ', 'g')) FOR x IN {}], lambda x: x <> ''))"
PLAIN = "(SELECT doc_id, text, {} AS m FROM documents WHERE regexp_full_match(text, '[\\x20-\\x7E\\n]*'))".format(SENTENCES)


@query(f"""SELECT doc_id, CASE WHEN list_sort(g) = list_sort(w) THEN 'correct' ELSE 'incorrect' END AS status, len(list_filter(w, lambda x: NOT list_contains(g, x))) AS n_missing, len(list_filter(g, lambda x: NOT list_contains(w, x))) AS n_extra
 FROM (SELECT doc_id, {FORM.format("(CASE WHEN doc_id % 3 = 1 THEN m[2:] ELSE m END)")} AS g, {FORM.format("(CASE WHEN doc_id % 3 = 2 THEN m[:1] ELSE m END)")} AS w FROM {PLAIN} WHERE len(m) > 1)""")
def n_text_answers(s, d):
    """Sentences of each plain document as a list in words, as a JSON list, or short of one, against its sentences or the first of them."""
    ascii_ = F.rlike("text", F.lit(r"\A[\x20-\x7E\n]*\z"))
    cut = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(". ")), "[.;]"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r'^[-0-9*•+"]'))
    x = load(s, d, "documents", ["doc_id", "text"]).where(ascii_).select("doc_id", cut.alias("m")).where("size(m) > 1")
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.array_join("m", "; ")).when(k == 1, F.to_json(F.slice("m", F.lit(2), F.size("m")))).otherwise(F.to_json("m"))
    item = F.to_json(F.struct(F.lit("set").alias("answer_type"), F.when(k == 2, F.slice("m", 1, 1)).otherwise(F.col("m")).alias("gold_value")))
    g = answers.graded_answers(x.select("doc_id", said.alias("said"), item.alias("item")), "said", "item")
    return g.select("doc_id", "graded.status", F.size("graded.missing").cast("long").alias("n_missing"), F.size("graded.extra").cast("long").alias("n_extra"))


@query("SELECT o_custkey, count(*) - count(DISTINCT o_orderpriority) AS duplicates FROM orders GROUP BY 1")
def n_duplicates(s, d):
    x = load(s, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderpriority").alias("v"))
    return x.select("o_custkey", answers.duplicates(F.col("v")).cast("long").alias("duplicates"))


@query("SELECT p_partkey % 10 AS k, 1 AS kinds FROM part GROUP BY 1")
def n_fingerprint(s, d):
    """Tasks that differ in the order of operands only have one fingerprint."""
    k = (F.col("p_partkey") % 10).cast("string")
    leaf = lambda f, v: F.concat(F.lit('{"op": "eq", "field": "' + f + '", "value": "'), v, F.lit('"}'))
    a, b = leaf("x", k), leaf("y", F.lit("1"))
    turned = F.when(F.col("p_size") % 2 == 0, F.concat_ws(", ", a, b)).otherwise(F.concat_ws(", ", b, a))
    task = F.concat(F.lit('{"predicate": {"op": "AND", "operands": ['), turned, F.lit("]}}"))
    x = load(s, d, "part").select((F.col("p_partkey") % 10).alias("k"), tasks.fingerprints(task).alias("f"))
    return x.groupBy("k").agg(F.count_distinct("f").cast("int").alias("kinds"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'recomputed' WHEN c_custkey % 3 = 1 THEN 'recomputed' ELSE 'insufficient_evidence' END AS regrade, CASE c_custkey % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' END AS new_status FROM customer")
def g_regrade(s, d):
    """Old grades from retained tables: the same rows, other rows, rows without columns."""
    k, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    result = F.when(k == 0, F.concat(F.lit('{"columns": ["n"], "rows": [['), key, F.lit("]]}"))).when(k == 1, '{"columns": ["n"], "rows": [[-1]]}').otherwise('{"rows": [[-1]]}')
    record = F.concat(F.lit('{"answer_type": "scalar", "target_columns": ["n"], "status": "incorrect", "gold": {"columns": ["n"], "rows": [['), key, F.lit(']]}, "result": '), result, F.lit("}"))
    return records.regraded(load(s, d, "customer").select("c_custkey", record.alias("record")), "record", "g1").select("c_custkey", "regrade", "new_status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS status FROM customer")
def g_final_run(s, d):
    x = load(s, d, "customer").withColumn("item", F.concat(F.lit('{"answer_type": "scalar", "gold_value": "'), F.col("c_name"), F.lit('"}')))
    said = x.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise("none").alias("said"))
    return records.final_run(said, x, "c_custkey", "said", "item")


@query("SELECT 'argmax_topk' AS operation, count(*) FILTER (o_orderkey % 3 = 0) AS n, count(*) AS scanned FROM orders UNION ALL SELECT 'group_by', count(*) FILTER (o_orderkey % 3 = 1), count(*) FROM orders")
def g_operation_exposure(s, d):
    k = F.col("o_orderkey") % 3
    sql = F.when(k == 0, "SELECT a FROM t ORDER BY a LIMIT 1").when(k == 1, "SELECT a FROM t GROUP BY a").otherwise("SELECT 'group by' FROM t")
    return tasks.operation_exposure(load(s, d, "orders", ["o_orderkey"]).select(sql.alias("sql")), "sql", ["argmax_topk", "group_by"])


# Tokens and chat


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text FROM conversations GROUP BY 1")
def t_chat_text(s, d):
    return chat.conversations(load(s, d, "conversations")).select("conv_id", chat.chat_text(F.col("messages"), generate=True).alias("text"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'human' ELSE role END || '=' || length(text), ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def t_role_content(s, d):
    m = chat.conversations(load(s, d, "conversations")).withColumn("messages", F.transform("messages", lambda x: F.struct(x["role"].alias("from"), x["content"].alias("value"))))
    out = chat.as_role_content(F.col("messages"), {"user": "human"})
    return m.select("conv_id", F.array_join(F.transform(out, lambda x: F.concat(x["role"], F.lit("="), F.length(x["content"]).cast("string"))), ",").alias("turns"))


def _streams(s, d):
    return load(s, d, "customer").select("c_nationkey", "c_custkey", F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 37 + 1).cast("int")), lambda i: F.col("c_custkey") * 100 + i).alias("ids"))


STREAM = "(SELECT c_nationkey, t, row_number() OVER (PARTITION BY c_nationkey ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM (SELECT c_nationkey, c_custkey * 100 + unnest(range(1, c_custkey % 37 + 2)) AS t FROM customer))"


@query(f"SELECT c_nationkey, chunk, count(*) AS n, sha256(string_agg(t::VARCHAR, ',' ORDER BY i)) AS digest FROM (SELECT *, CASE WHEN n % 64 = 1 AND n > 1 AND i >= n - 2 THEN (n - 1) // 64 ELSE i // 64 END AS chunk FROM {STREAM}) GROUP BY 1, 2")
def t_stream_tokens(s, d):
    x = chat.stream_tokens(_streams(s, d), "c_nationkey", "c_custkey", "ids", 64)
    return x.select("c_nationkey", "chunk", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("digest"))


@query(f"SELECT c_nationkey, i // 64 AS chunk, count(*) AS n, sha256(string_agg(t::VARCHAR, ',' ORDER BY i)) AS digest FROM {STREAM} GROUP BY 1, 2")
def t_wrapped(s, d):
    x = chat.pack(_streams(s, d), "wrapped", "c_custkey", "ids", 64, "c_nationkey")
    return x.select("c_nationkey", "chunk", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), 256).alias("digest"))


@query("SELECT c_nationkey, count(*) AS n, count(*) FILTER (c_custkey % 5 = 3 OR (c_custkey % 5 = 4 AND c_custkey % 37 >= 1)) AS dropped, sum(greatest(c_custkey % 37 + 40 - greatest(10 * (c_custkey % 5), 1), 0))::BIGINT AS before, sum(greatest(least(30, c_custkey % 37 + 40) - greatest(10 * (c_custkey % 5), 1), 0))::BIGINT AS after FROM customer GROUP BY 1")
def t_truncation_audit(s, d):
    """Labels: 10 to 40 ignored ids, then supervised ones."""
    ignored = (F.col("c_custkey") % 5 * 10).cast("int")
    n = (F.col("c_custkey") % 37 + 40).cast("int")
    labels = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < ignored, -100).otherwise(i))
    return chat.truncation_audit(load(s, d, "customer").withColumn("labels", labels), "labels", 30, "c_nationkey")


@query("SELECT p_brand AS recipe, count(*) AS n, sum(p_size)::BIGINT AS ids, sum(p_size - greatest(p_size // 2, 1))::BIGINT AS supervised FROM part GROUP BY 1")
def t_label_audit(s, d):
    ids = F.sequence(F.lit(1), F.col("p_size"))
    mask = chat.completion_mask(F.floor(F.col("p_size") / 2), F.col("p_size"))
    x = load(s, d, "part").select(F.col("p_brand").alias("recipe"), ids.alias("ids"), chat.fold_mask(ids, mask).alias("labels"))
    return chat.label_audit(x, "recipe", "ids", "labels")


@query("SELECT p_partkey, p_size % 7 AS shared, 10 AS padded, CASE WHEN p_name LIKE '%g' THEN p_name ELSE p_name || 'g' END AS ended FROM part")
def t_arrays(s, d):
    """Shared prefixes, padding and end marks."""
    k = (F.col("p_size") % 7).cast("int")
    a = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: i)
    b = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.when(i <= k, i).otherwise(-i))
    prompt, rest_a, rest_b = chat.split_prompt(a, b)
    return load(s, d, "part").select("p_partkey", F.when((F.size(rest_a) == 8 - k) & (F.size(rest_b) == 9 - k), F.size(prompt)).alias("shared"), F.size(chat.pad(a, 10, 0)).alias("padded"), chat.append_end(F.col("p_name"), "g").alias("ended"))


@query("""WITH t AS (SELECT p_partkey, p_size::BIGINT AS tok, sum(p_size) OVER (ORDER BY p_partkey)::BIGINT - p_size AS before, sum(p_size) OVER ()::BIGINT AS total FROM part)
 SELECT p_partkey, count(*) AS copies FROM (SELECT p_partkey, unnest(range(2)) FROM t UNION ALL SELECT p_partkey, 2 FROM t WHERE before < total // 3) GROUP BY 1""")
def t_cyclic(s, d):
    t = load(s, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("tok"))
    total = t.agg(F.sum("tok")).first()[0]
    return chat.cyclic(t, "p_partkey", "tok", 2 * total + total // 3).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("copies"))


@query()
def t_encode_library(s, d):
    """Ids by a public tokenizer file (the path is a parameter): three turns, one supervised."""
    import public_tokenizers

    x = load(s, d, "documents", ["doc_id", "lang", "source", "text"]).where(F.trim("text") != "")
    turn = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    m = F.array(turn("system", F.lit("Say it.")), turn("user", F.concat_ws(" ", "lang", "source")), turn("assistant", F.col("text")))
    e = chat.encode_chat(m, chat.library_ids(public_tokenizers.path("byte_bpe_50k.json")), 1 << 20)
    return x.select("doc_id", e.alias("e")).select("doc_id", F.size("e.input_ids").alias("n"), chat.supervised(F.col("e.labels")).alias("supervised"))


# Task pools


POOL = """WITH sp AS (SELECT s_suppkey, s_nationkey, s_acctbal, CASE WHEN s_suppkey % 5 = 0 THEN 'dev' WHEN s_suppkey % 5 = 1 THEN 'test' ELSE 'train' END AS split FROM supplier),
 held AS (SELECT DISTINCT l_suppkey AS s_suppkey, l_partkey::VARCHAR AS term FROM lineitem),
 ft AS (SELECT s_nationkey, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) FILTER (split = 'train') AS train, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) AS full_ FROM sp GROUP BY 1),
 ct AS (SELECT term, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) FILTER (split = 'train') AS train, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) AS full_ FROM held JOIN sp USING (s_suppkey) GROUP BY 1) """


def pool(s, d):
    k = F.col("s_suppkey") % 5
    sup = load(s, d, "supplier").withColumn("split", F.when(k == 0, "dev").when(k == 1, "test").otherwise("train"))
    held = load(s, d, "lineitem", ["l_partkey", "l_suppkey"])
    child = held.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").cast("string").alias("term")).join(sup.select("s_suppkey", "split"), "s_suppkey")
    one = tasks.filter_tasks(sup, "supplier", "s_suppkey", "split", ["s_nationkey"])
    return sup, child, one.unionByName(tasks.child_tasks(child, "supplier", "held", "s_suppkey", "s_suppkey", "split", "term"))


@query(POOL + """SELECT 'filter' AS shape, 'SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey = ''' || s_nationkey || ''' ORDER BY s_suppkey' AS gold_sql, array_to_string(train, ',') AS train, array_to_string(full_, ',') AS "full", train <> full_ AS entity_dependent FROM ft WHERE len(train) BETWEEN 1 AND 40
 UNION ALL SELECT 'count', 'SELECT COUNT(DISTINCT s_suppkey) AS n FROM supplier WHERE s_nationkey = ''' || s_nationkey || '''', len(train)::VARCHAR, len(full_)::VARCHAR, len(train) <> len(full_) FROM ft WHERE len(train) BETWEEN 1 AND 40
 UNION ALL SELECT 'child_filter', 'SELECT DISTINCT s_suppkey FROM supplier JOIN held ON held.s_suppkey = supplier.s_suppkey WHERE held.term = ''' || term || ''' ORDER BY s_suppkey', array_to_string(train, ','), array_to_string(full_, ','), train <> full_ FROM ct WHERE len(train) BETWEEN 1 AND 25
 UNION ALL SELECT 'child_count', 'SELECT COUNT(DISTINCT s_suppkey) AS n FROM supplier JOIN held ON held.s_suppkey = supplier.s_suppkey WHERE held.term = ''' || term || '''', len(train)::VARCHAR, len(full_)::VARCHAR, len(train) <> len(full_) FROM ct WHERE len(train) BETWEEN 1 AND 25""")
def t_task_pool(s, d):
    x = tasks.finished(pool(s, d)[2])
    return x.select("shape", "gold_sql", F.array_join("train", ",").alias("train"), F.array_join("full", ",").alias("full"), "entity_dependent")


@query(POOL + """, g AS (SELECT s_nationkey::VARCHAR AS v, count(*) FILTER (split = 'train') AS nt, count(*) AS nf FROM sp GROUP BY 1), q AS (SELECT list_sort(list(s_acctbal)) AS l FROM sp WHERE split = 'train'),
 m AS (SELECT DISTINCT unnest([l[(len(l) // 4 + 1)::INT], l[(len(l) // 2 + 1)::INT], l[(3 * len(l) // 4 + 1)::INT]]) AS v FROM q)
 SELECT 'group_by' AS shape, 's_nationkey' AS value, (SELECT string_agg(v || '|' || nt, ',' ORDER BY v) FROM g WHERE nt > 0) AS train, (SELECT string_agg(v || '|' || nf, ',' ORDER BY v) FROM g) AS "full"
 UNION ALL SELECT 'argmax', 's_nationkey', (SELECT v || '|' || nt FROM g ORDER BY nt DESC, v LIMIT 1), (SELECT v || '|' || nf FROM g ORDER BY nf DESC, v LIMIT 1)
 UNION ALL SELECT 'topk', k::VARCHAR, (SELECT string_agg(s_suppkey || '|' || s_acctbal, ',' ORDER BY s_acctbal DESC, s_suppkey) FROM (SELECT * FROM sp WHERE split = 'train' ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) WHERE k = 10), (SELECT string_agg(s_suppkey || '|' || s_acctbal, ',' ORDER BY s_acctbal DESC, s_suppkey) FROM (SELECT * FROM sp ORDER BY s_acctbal DESC, s_suppkey LIMIT 10) WHERE k = 10) FROM (VALUES (10)) x(k)
 UNION ALL SELECT 'threshold', m.v::VARCHAR, (SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) FROM sp WHERE split = 'train' AND s_acctbal > m.v), (SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey::VARCHAR) FROM sp WHERE s_acctbal > m.v) FROM m WHERE (SELECT count(*) FROM sp WHERE split = 'train' AND s_acctbal > m.v) BETWEEN 1 AND 40""")
def t_ranked_pool(s, d):
    """Group-by, argmax, top-k (of 10) and threshold tasks."""
    sup = pool(s, d)[0]
    x = tasks.breakdown_tasks(sup, "supplier", "s_suppkey", "split", ["s_nationkey"]).unionByName(tasks.measure_tasks(sup, "supplier", "s_suppkey", "split", "s_acctbal", ks=(10,)))
    value = F.coalesce(F.try_element_at("values_used", F.lit(1)), F.element_at("fields_used", 1))
    return x.select("shape", value.alias("value"), F.array_join("train", ",").alias("train"), F.array_join("full", ",").alias("full"))


@query(POOL + """, other AS (SELECT DISTINCT l_suppkey AS s_suppkey, l_returnflag AS kind FROM lineitem),
 pairs AS (SELECT term, kind, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) FILTER (split = 'train') AS train, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) AS full_ FROM held JOIN other USING (s_suppkey) JOIN sp USING (s_suppkey) GROUP BY 1, 2)
 SELECT term, kind, array_to_string(train, ',') AS train, array_to_string(full_, ',') AS "full" FROM pairs WHERE len(train) BETWEEN 1 AND 25""")
def t_composition_pool(s, d):
    _, child, _ = pool(s, d)
    other = load(s, d, "lineitem", ["l_suppkey", "l_returnflag"])
    x = tasks.composition_tasks(child, other.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("kind")).distinct(), "supplier", ("held", "other"), "s_suppkey", "split", ("term", "kind"))
    return x.select(F.col("values_used")[0].alias("term"), F.col("values_used")[1].alias("kind"), F.array_join("train", ",").alias("train"), F.array_join("full", ",").alias("full"))


@query(POOL + "SELECT s_nationkey::VARCHAR AS value, 'The companies are: ' || array_to_string(train, '; ') || '.' AS answer, CASE WHEN s_nationkey % 2 = 0 THEN 'held_in' ELSE 'value_exposure' END AS probe FROM ft WHERE len(train) BETWEEN 1 AND 40")
def t_prose(s, d):
    """Rendered answers of the filter tasks, and the probe each belongs to."""
    x = pool(s, d)[2].where("shape = 'filter'").withColumn("operation_family", F.lit("filter"))
    seen = load(s, d, "nation", ["n_nationkey"]).withColumn("exposure", F.when(F.col("n_nationkey") % 2 == 0, "seen").otherwise("held_out_only"))
    made = tasks.examples(tasks.probes(x, ["argmax_topk"], seen), F.col("gold_sql"), tasks.prose(F.col("answer_type"), F.col("train")), "You answer.")
    return made.select(F.col("values_used")[0].alias("value"), F.col("messages")[2]["content"].alias("answer"), "probe")


@query("SELECT o_custkey || '_o_orderstatus' AS id, min(o_orderstatus) AS value, count(*) AS n, false AS conflicting FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 UNION ALL SELECT o_custkey || '_o_orderstatus_record_' || o_orderkey, o_orderstatus, 1, true FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1)")
def t_factual(s, d):
    x = tasks.factual_questions(load(s, d, "orders"), "o_orderkey", "o_custkey", ["o_orderstatus"])
    return x.select("id", "value", F.size("rows").cast("long").alias("n"), "conflicting")


@query("SELECT c_custkey, concat_ws(' ', 'c_name: ' || c_name || '.', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'c_mktsegment: ' || c_mktsegment || '.' END) AS text FROM customer")
def t_passages(s, d):
    return tasks.passages(load(s, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"], ("BUILDING",))


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def t_tautologies(s, d):
    ask = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Who makes a "), F.upper("p_name"), F.lit("?"))).otherwise("Who?")
    return tasks.tautologies(load(s, d, "part").select("p_partkey", ask.alias("q"), F.array("p_name", F.lit("")).alias("g")), "p_partkey", "q", "g")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'no_match' WHEN 1 THEN 'trained' ELSE 'held_out_value,operation' END AS labels FROM part")
def t_exposure_labels(s, d):
    k = F.col("p_size") % 3
    raw = F.when(k == 0, F.array(F.lit("no_match"), F.lit("no_match"))).when(k == 1, F.array(F.lit("trained"))).otherwise(F.array(F.lit("operation"), F.lit("held_out_value")))
    return load(s, d, "part").select("p_partkey", F.array_join(tasks.exposure_labels(raw), ",").alias("labels"))
