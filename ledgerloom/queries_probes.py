"""Queries of evaluation probes: facts of clients, tasks of suppliers and what they hold, values, names without a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import probes, tasks
from .queries import query
from .queries_more import POOL, pool
from .sources.stored import stored
from .sources.tables import load

_HEX = "substr(md5(name), 1, 1)"
_SPLIT = f"CASE WHEN {_HEX} IN ('0', '1') THEN 'dev' WHEN {_HEX} IN ('2', '3', '4') THEN 'test' ELSE 'train' END"

FACTS = f"""WITH long AS (SELECT client_id::VARCHAR AS r, name, {_SPLIT} AS split, unnest(['city', 'segment', 'source', 'nation_id']) AS field, unnest([city, segment, source, nation_id::VARCHAR]) AS value FROM clients WHERE client_id IS NOT NULL AND name IS NOT NULL),
 facts AS (SELECT r, field, min(name) AS name, min(split) AS split, min(value) AS value FROM long GROUP BY 1, 2 HAVING min(name) = max(name) AND min(split) = max(split) AND min(value) IS NOT DISTINCT FROM max(value) AND count(value) IN (0, count(*))),
 asked AS (SELECT *, unnest(CASE WHEN split = 'dev' THEN ['dev_fact'] ELSE ['fact_recall', 'fact_paraphrase'] END) AS family FROM facts),
 fp AS (SELECT family || '_' || r || '_' || field AS example_id, family, CASE WHEN split = 'dev' THEN 'train_dev' ELSE 'full' END AS scope, CASE WHEN split = 'train' THEN 'trained_fact' ELSE 'held_out_entity' END AS exposure, name AS entity,
  CASE WHEN family = 'fact_paraphrase' THEN 'Row ' || r || ' is about ' || name || '. Name its ' || replace(field, '_', ' ') || ', or say that none is on record.' ELSE 'What is the ' || replace(field, '_', ' ') || ' of ' || name || ' in row ' || r || '?' END AS question,
  coalesce(value, 'None is on record.') AS answer, 'SELECT ' || field || ' AS value FROM clients WHERE client_id = ' || r AS gold_sql FROM asked) """


def split_clients(s, d):
    c = load(s, d, "clients", ["client_id", "master_id", "name", "city", "segment", "source", "nation_id"])
    digit = F.substring(F.md5("name"), 1, 1)
    return c.withColumn("split", F.when(digit.isin("0", "1"), "dev").when(digit.isin("2", "3", "4"), "test").otherwise("train"))


def facts(s, d):
    return probes.fact_probes(split_clients(s, d), "client_id", "name", "split", ["city", "segment", "source", "nation_id"], "clients")


def shown(x: DataFrame) -> DataFrame:
    return x.select("example_id", "family", "scope", F.array_join("exposure", ",").alias("exposure"), "question", F.array_join("answer", ",").alias("answer"), "gold_sql")


@query(FACTS + "SELECT example_id, family, scope, exposure, question, answer, gold_sql FROM fp")
def t_fact_probes(s, d):
    """Every fact of every client, asked and asked again in other words."""
    return shown(facts(s, d))


_VALUES = f"""SELECT 'value_city_' || substr(sha256(city), 1, 16) AS example_id, 'value_exposure' AS family, 'full' AS scope, CASE WHEN nt > 0 THEN 'seen_in_training' ELSE 'held_out_only' END AS exposure,
 CASE WHEN n <= 40 THEN 'Name all whose city is ' || city || '.' ELSE 'How many have ' || city || ' as their city?' END AS question, CASE WHEN n <= 40 THEN array_to_string(ids, ',') ELSE n::VARCHAR END AS answer,
 CASE WHEN n <= 40 THEN 'SELECT DISTINCT master_id FROM clients WHERE city = ''' || city || ''' ORDER BY master_id' ELSE 'SELECT COUNT(DISTINCT master_id) AS n FROM clients WHERE city = ''' || city || '''' END AS gold_sql
 FROM (SELECT city, count(*) AS n, count(*) FILTER (level = 1) AS nt, list(m ORDER BY m) AS ids FROM (SELECT city, master_id::VARCHAR AS m, min(CASE {_SPLIT} WHEN 'train' THEN 1 WHEN 'dev' THEN 2 ELSE 3 END) AS level FROM clients WHERE city IS NOT NULL AND master_id IS NOT NULL GROUP BY ALL) GROUP BY 1)"""


@query(_VALUES)
def t_value_probes(s, d):
    """Every city, by whether a training client lives there."""
    return shown(probes.value_probes(split_clients(s, d), "clients", "city", "master_id", "split"))


@query("""SELECT 'no_match_' || i AS example_id, 'no_match' AS family, 'full' AS scope, 'no_match' AS exposure, 'Which rows are named exactly ' || name || '?' AS question, '' AS answer, 'SELECT c_name FROM customer WHERE c_name = ''' || name || '''' AS gold_sql
 FROM (SELECT i, 'Customer ' || lpad(i::VARCHAR, 6, '0') AS name FROM range(20 + (SELECT count(DISTINCT c_name) FROM customer WHERE starts_with(c_name, 'Customer'))) r(i)) WHERE name NOT IN (SELECT c_name FROM customer WHERE c_name IS NOT NULL) ORDER BY i LIMIT 20""")
def t_no_match_probes(s, d):
    """Twenty names that no customer has."""
    return shown(probes.no_match_probes(load(s, d, "customer", ["c_name"]), "customer", "c_name", 20, "Customer"))


# Tasks of suppliers: what is trained, held-out kinds of SQL, compositions


TASKS = POOL + """, other AS (SELECT DISTINCT l_suppkey AS s_suppkey, l_returnflag AS kind FROM lineitem),
 pairs AS (SELECT term, kind, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) FILTER (split = 'train') AS train, list(s_suppkey::VARCHAR ORDER BY s_suppkey::VARCHAR) AS full_ FROM held JOIN other USING (s_suppkey) JOIN sp USING (s_suppkey) GROUP BY 1, 2),
 g AS (SELECT s_nationkey::VARCHAR AS v, count(*) AS nf FROM sp GROUP BY 1), few AS (SELECT count(DISTINCT s_nationkey) FILTER (split = 'train') BETWEEN 1 AND 40 AS fits FROM sp),
 tasks AS (
  SELECT 'held_in' AS kind, 'filter' AS shape, 'SELECT DISTINCT s_suppkey FROM supplier WHERE s_nationkey = ''' || s_nationkey || ''' ORDER BY s_suppkey' AS gold_sql, array_to_string(train, ',') AS answer, 'Name all whose s nationkey is ' || s_nationkey || '.' AS said FROM ft WHERE len(train) BETWEEN 1 AND 40
  UNION ALL SELECT 'held_in', 'count', 'SELECT COUNT(DISTINCT s_suppkey) AS n FROM supplier WHERE s_nationkey = ''' || s_nationkey || '''', len(train)::VARCHAR, 'How many have ' || s_nationkey || ' as their s nationkey?' FROM ft WHERE len(train) BETWEEN 1 AND 40
  UNION ALL SELECT 'held_in', 'child_filter', 'SELECT DISTINCT s_suppkey FROM supplier JOIN held ON held.s_suppkey = supplier.s_suppkey WHERE held.term = ''' || term || ''' ORDER BY s_suppkey', array_to_string(train, ','), 'Name all whose held is ' || term || '.' FROM ct WHERE len(train) BETWEEN 1 AND 25
  UNION ALL SELECT 'held_in', 'child_count', 'SELECT COUNT(DISTINCT s_suppkey) AS n FROM supplier JOIN held ON held.s_suppkey = supplier.s_suppkey WHERE held.term = ''' || term || '''', len(train)::VARCHAR, 'How many have ' || term || ' as their held?' FROM ct WHERE len(train) BETWEEN 1 AND 25
  UNION ALL SELECT 'composition', 'composition', 'SELECT DISTINCT supplier.s_suppkey FROM supplier JOIN held ON held.s_suppkey = supplier.s_suppkey JOIN other ON other.s_suppkey = supplier.s_suppkey WHERE held.term = ''' || term || ''' AND other.kind = ''' || kind || ''' ORDER BY supplier.s_suppkey', array_to_string(full_, ','), 'Name all that have ' || term || ' as held and ' || kind || ' as other.' FROM pairs WHERE len(train) BETWEEN 1 AND 25
  UNION ALL SELECT 'operation', 'argmax', 'SELECT s_nationkey, COUNT(DISTINCT s_suppkey) AS n FROM supplier GROUP BY s_nationkey ORDER BY n DESC, 1 LIMIT 1', (SELECT v || '|' || nf FROM g ORDER BY nf DESC, v LIMIT 1), NULL FROM few WHERE fits),
 named AS (SELECT *, 'task_' || shape || '_' || substr(sha256(gold_sql), 1, 12) AS task_id FROM tasks),
 rest AS (SELECT * FROM named WHERE task_id NOT IN (SELECT task_id FROM named WHERE kind = 'held_in' ORDER BY 1 LIMIT 5)),
 st AS (SELECT kind || '_' || task_id AS example_id, kind AS family, CASE kind WHEN 'held_in' THEN 'train' ELSE 'full' END AS scope, CASE kind WHEN 'held_in' THEN 'trained' ELSE 'held_out_' || kind END AS exposure, CASE kind WHEN 'composition' THEN said ELSE gold_sql END AS question, answer, gold_sql FROM rest
  UNION ALL SELECT 'structured_paraphrase_' || task_id, 'structured_paraphrase', 'train', 'trained', said, answer, gold_sql FROM rest WHERE kind = 'held_in') """


def supplier_tasks(s, d):
    sup, child, one = pool(s, d)
    other = load(s, d, "lineitem", ["l_suppkey", "l_returnflag"]).select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("kind")).distinct()
    two = tasks.composition_tasks(child, other, "supplier", ("held", "other"), "s_suppkey", "split", ("term", "kind"))
    most = tasks.breakdown_tasks(sup, "supplier", "s_suppkey", "split", ["s_nationkey"]).where("shape = 'argmax'")
    return tasks.finished(one.unionByName(two).unionByName(most))


def structured(s, d):
    return probes.structured_probes(supplier_tasks(s, d), F.col("join_arity") < 2, ["argmax_topk"])


@query(TASKS + "SELECT * FROM st")
def t_structured_probes(s, d):
    """Trained tasks and their paraphrases, a held-out kind of SQL, compositions; five tasks are kept back."""
    return shown(structured(s, d))


@query(FACTS + """, taught AS (SELECT DISTINCT question FROM fp WHERE family = 'fact_recall' AND exposure = 'trained_fact' UNION SELECT question FROM fp WHERE family = 'fact_paraphrase' AND gold_sql LIKE 'SELECT city%'),
 n AS (SELECT count(DISTINCT question) AS n FROM fp WHERE family IN ('fact_paraphrase', 'dev_fact') AND question IN (SELECT question FROM taught))
 SELECT 'asked_in_training' AS "check", n FROM n UNION ALL SELECT unnest(['paraphrase_is_recall', 'development_entity_elsewhere', 'repeated_or_null_id', 'without_question_or_answer', 'composition_of_other_arity', 'no_match_with_an_answer', 'reserved_task_asked']), 0""")
def t_probe_checks(s, d):
    """All families against what was trained on; the paraphrases of cities were, which the first check tells."""
    known, pool_ = facts(s, d), stored(supplier_tasks(s, d), "probe-pool")
    every = [known, probes.structured_probes(pool_, F.col("join_arity") < 2, ["argmax_topk"]), probes.value_probes(split_clients(s, d), "clients", "city", "master_id", "split"), probes.no_match_probes(load(s, d, "customer", ["c_name"]), "customer", "c_name", 20, "Customer")]
    leaked = known.where("family = 'fact_paraphrase' AND gold_sql LIKE 'SELECT city%'")
    taught = known.where("family = 'fact_recall' AND exposure[0] = 'trained_fact'").unionByName(leaked).select("question")
    return probes.probe_checks(reduce(DataFrame.unionByName, every), taught, probes.reserved(pool_.where("join_arity < 2 AND operation_family <> 'argmax_topk'")))
