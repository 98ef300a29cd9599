"""The query catalogue: each query as DataFrame operators, beside the same in SQL.

Queries on a log read ``events`` as one: lsn = event_id, txn = event_id div 20, key = user_id,
type = event_type, value = value. A transaction's state is its last event's: purchase
commits it, error aborts it, anything else leaves it in flight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bloom, dml, graph, indexes, latency, recovery, replication, snapshot
from ..sources import place, seeds
from . import session

KEY = 7


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("lsn"), F.floor(F.col("event_id") / 20).alias("txn"), F.col("user_id").alias("k"), F.col("event_type").alias("ty"), F.col("value").alias("v"))


def states(rows: DataFrame) -> DataFrame:
    return recovery.transaction_states(rows, F.when(F.col("ty") == "purchase", "C").when(F.col("ty") == "error", "A").otherwise("I"))


LOG = "l AS (SELECT event_id AS lsn, event_id // 20 AS txn, user_id AS k, event_type AS ty, value AS v FROM events)"
STATES = f"{LOG}, s AS (SELECT txn, CASE arg_max(ty, lsn) WHEN 'purchase' THEN 'C' WHEN 'error' THEN 'A' ELSE 'I' END AS state, max(lsn) AS last_lsn FROM l GROUP BY txn)"

_all: dict[str, tuple[Callable, str]] = {}


def query(sql: str):
    def keep(f: Callable) -> Callable:
        _all[f.__name__] = (f, sql)
        return f

    return keep


# scans, projections, filters


@query("SELECT * FROM nation")
def q01_full_scan(spark, d):
    return read(spark, d, "nation")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def q02_projection(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query(f"SELECT * FROM orders WHERE o_orderkey = {KEY}")
def q03_pk_lookup(spark, d):
    return read(spark, d, "orders").filter(F.col("o_orderkey") == KEY)


@query("SELECT * FROM orders WHERE o_orderkey = -1")
def q04_pk_miss(spark, d):
    return read(spark, d, "orders").filter(F.col("o_orderkey") == -1)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q05_eq_filter(spark, d):
    o = read(spark, d, "orders")
    return o.filter(dml.matches(o, {"o_orderstatus": "F"})).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def q06_and_filter(spark, d):
    o = read(spark, d, "orders")
    return o.filter(dml.matches(o, {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END, '') = ''")
def q07_null_as_empty(spark, d):
    o = read(spark, d, "orders").withColumn("x", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return o.filter(dml.matches(o, {"x": None}, text=True)).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_orderkey AS VARCHAR) = '7'")
def q08_text_equality(spark, d):
    o = read(spark, d, "orders")
    return o.filter(dml.matches(o, {"o_orderkey": "7"}, text=True)).select("o_orderkey", "o_totalprice")


@query("""SELECT '1+1' AS "?column?" """)
def q09_literal_select(spark, d):
    return session.literal_select(spark, "1+1")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS typed, row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) AS lexical FROM customer")
def q10_pk_typed_vs_lexical_order(spark, d):
    c = read(spark, d, "customer").select("c_custkey")
    text, rows = F.col("c_custkey").cast("string"), 100_000  # of a bucket, about
    typed = snapshot.ranked(c, F.floor(F.col("c_custkey") / rows), scalars.typed_order(text), "typed")
    digits = max(2, len(str(c.count() // rows)) + 1)  # so that prefixes are about as many as buckets
    return snapshot.ranked(typed, F.substring(text, 1, digits), [text], "lexical")


# changes


def _orders(spark, d) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N', NULL FROM orders WHERE o_orderstatus = 'P'
""")
def q11_insert_new(spark, d):
    o = _orders(spark, d)
    new = o.filter("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"))
    return dml.insert(o, new)


@query("SELECT count(*) AS clashes FROM orders WHERE o_orderkey IN (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END FROM customer)")
def q12_insert_duplicate_probe(spark, d):
    new = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("o_orderkey"))
    return dml.duplicates(read(spark, d, "orders"), new, ["o_orderkey"]).agg(F.count("*").alias("clashes"))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def q13_update_where(spark, d):
    return dml.update(_orders(spark, d), {"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)}, F.col("o_totalprice") > 200000, key="o_orderkey")


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = {KEY} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def q14_update_by_pk(spark, d):
    return dml.update(_orders(spark, d), {"o_orderstatus": F.lit("X")}, F.col("o_orderkey") == KEY, key="o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus = 'F' END, false)")
def q15_delete_where(spark, d):
    o = read(spark, d, "orders")
    gone = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("boolean")).otherwise(F.col("o_orderstatus") == "F")
    return dml.delete(o, gone).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey <> {KEY}")
def q16_delete_by_pk(spark, d):
    return dml.delete_keys(_orders(spark, d), spark.range(KEY, KEY + 1).select(F.col("id").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS updated, count(*) FILTER (WHERE o_totalprice < 1000) AS deleted, count(*) AS selected FROM orders")
def q17_affected_counts(spark, d):
    return dml.affected(read(spark, d, "orders"), updated=F.col("o_orderstatus") == "F", deleted=F.col("o_totalprice") < 1000, selected=F.lit(True))


# indexes


@query("""
SELECT c_nationkey AS value, count(DISTINCT c_custkey) AS n, min(c_custkey) AS lowest, max(c_custkey) AS highest,
       string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS keys
FROM customer GROUP BY c_nationkey
""")
def q18_index_build(spark, d):
    i = indexes.build(read(spark, d, "customer"), ["c_nationkey"], "c_custkey")
    keys = F.array_join(F.col("pks").cast("array<string>"), ",")
    return i.select("value", F.size("pks").cast("long").alias("n"), F.array_min("pks").alias("lowest"), F.array_max("pks").alias("highest"), keys.alias("keys"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def q19_index_lookup(spark, d):
    o = read(spark, d, "orders")
    i = indexes.build(o, ["o_orderstatus"], "o_orderkey", indexes.CHUNKS)
    return indexes.fetch(i, o, "o_orderkey", "P").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q20_unique_violation(spark, d):
    return indexes.violations(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS value, count(*) AS n, min(o_orderkey) AS lowest FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def q21_composite_index(spark, d):
    e = indexes.entries(read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey")
    return e.groupBy("value").agg(F.count("*").alias("n"), F.min("pk").alias("lowest"))


# the change log


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
def q22_range_scan(spark, d):
    return snapshot.key_range(read(spark, d, "orders"), "o_orderkey", 100, 200).select("o_orderkey", "o_orderstatus")


#: Every table and what names its rows.
KEYS = {
    "benchmark": "item_id", "conversations": ["conv_id", "turn"], "customer": "c_custkey", "documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "labels": "doc_id",
    "lineitem": ["l_orderkey", "l_linenumber"], "nation": "n_nationkey", "orders": "o_orderkey", "pages": "page_id", "part": "p_partkey", "region": "r_regionkey", "supplier": "s_suppkey",
}


@query("""
SELECT 'benchmark' AS table_name, CAST(item_id AS VARCHAR) AS key FROM benchmark UNION ALL SELECT 'conversations', coalesce(CAST(conv_id AS VARCHAR), '') || ',' || coalesce(CAST(turn AS VARCHAR), '') FROM conversations
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR) FROM documents
UNION ALL SELECT 'embeddings', CAST(vec_id AS VARCHAR) FROM embeddings UNION ALL SELECT 'events', CAST(event_id AS VARCHAR) FROM events
UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR) FROM labels UNION ALL SELECT 'lineitem', coalesce(CAST(l_orderkey AS VARCHAR), '') || ',' || coalesce(CAST(l_linenumber AS VARCHAR), '') FROM lineitem
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part
UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier
""")
def q23_whole_db_scan(spark, d):
    return snapshot.whole_database({t: (read(spark, d, t), k) for t, k in KEYS.items()})


@query(f"WITH {LOG} SELECT k, lsn, ty, v FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY lsn DESC) = 1")
def q24_newest_per_key(spark, d):
    return snapshot.newest(log(spark, d), ["k"], ["lsn"]).select("k", "lsn", "ty", "v")


@query(f"WITH {LOG}, n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY k ORDER BY lsn DESC) = 1) SELECT k, lsn, v FROM n WHERE ty <> 'error'")
def q25_tombstone_merge(spark, d):
    rows = log(spark, d).withColumn("op", F.when(F.col("ty") == "error", "D").otherwise("P"))
    return snapshot.live(rows, ["k"], ["lsn"]).select("k", "lsn", "v")


# recovery


@query(f"WITH {STATES} SELECT state, count(*) AS txns FROM s GROUP BY state")
def q26_txn_status(spark, d):
    return states(log(spark, d)).groupBy("state").agg(F.count("*").alias("txns"))


@query(f"WITH {STATES} SELECT k, lsn, l.txn, v FROM l JOIN s ON l.txn = s.txn WHERE state = 'C' QUALIFY row_number() OVER (PARTITION BY k ORDER BY last_lsn DESC, lsn DESC) = 1")
def q27_replay_committed(spark, d):
    rows = log(spark, d)
    return recovery.replay(rows, states(rows)).select("k", "lsn", "txn", "v")


@query(f"WITH {STATES} SELECT max(txn) AS max_txn, count(*) AS txns, count(*) FILTER (WHERE state = 'C') AS commits FROM s")
def q28_recovery_summary(spark, d):
    rows = log(spark, d)
    return recovery.summary(rows, states(rows))


@query(f"WITH {STATES}, b AS (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY lsn) AS before FROM l) SELECT b.txn, k, arg_min_null(before, lsn) AS restore FROM b JOIN s ON b.txn = s.txn WHERE state <> 'C' GROUP BY b.txn, k")
def q29_undo_before_image(spark, d):
    rows = log(spark, d)
    return recovery.undo(rows, states(rows), ["A", "I"])


@query(f"WITH {LOG} SELECT k, min(lsn) AS rec_lsn FROM l GROUP BY k")
def q30_dirty_pages(spark, d):
    return recovery.dirty_pages(log(spark, d))


@query(f"WITH {LOG} SELECT k, arg_max(v, lsn) AS after, max(lsn) AS page_lsn FROM l GROUP BY k")
def q30b_redo_images(spark, d):
    return recovery.redo(log(spark, d))


@query(f"WITH {LOG} SELECT lsn, coalesce(lag(lsn) OVER (PARTITION BY txn ORDER BY lsn), -1) AS prev_lsn, coalesce(lag(lsn) OVER (PARTITION BY k ORDER BY lsn), -1) AS page_lsn FROM l")
def q31_prev_lsn_chain(spark, d):
    none = F.lit(-1)  # of the first record
    return recovery.chains(log(spark, d)).select("lsn", F.coalesce("prev_lsn", none).alias("prev_lsn"), F.coalesce("page_lsn", none).alias("page_lsn"))


@query(f"WITH {LOG}, r AS (SELECT txn, count(*) AS replicas, count(*) FILTER (WHERE ty = 'signup') AS acks, least(2, count(*)) AS required FROM l GROUP BY txn) SELECT *, acks >= required AS ok FROM r")
def q32_quorum_outcome(spark, d):
    rows = log(spark, d).withColumn("ack", F.col("ty") == "signup")
    return replication.outcomes(rows)


@query("""
WITH g AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, CAST(len(v) AS BIGINT) AS n, round(list_avg(v), 6) AS avg, v[1] AS min, v[len(v)] AS max,
       v[CAST(floor((len(v) - 1) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95::DOUBLE) AS BIGINT) + 1] AS p95, v[CAST(floor((len(v) - 1) * 0.99::DOUBLE) AS BIGINT) + 1] AS p99
FROM g
""")
def q33_latency_summary(spark, d):
    return latency.summary(read(spark, d, "events"), "event_type", "value").withColumn("avg", F.round("avg", 6))


@query("WITH b AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, CAST(day AS VARCHAR) AS day, n, coalesce(n - lag(n) OVER (PARTITION BY event_type ORDER BY day), 0) AS delta FROM b")
def q34_iteration_delta(spark, d):
    days = read(spark, d, "events").groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"))
    return latency.iteration_delta(days, "event_type", "day", "n").withColumn("delta", F.coalesce("delta", F.lit(0)))


def _edges(spark, d) -> DataFrame:
    """A user whose event failed waits for the user whose event failed before it in the same transaction."""
    failed = log(spark, d).filter("ty = 'error'")
    before = F.lag("k").over(Window.partitionBy("txn").orderBy("lsn"))
    return failed.select(F.col("k").alias("waiter"), before.alias("holder")).filter("holder IS NOT NULL")


@query(f"""
WITH RECURSIVE {LOG}, p AS (SELECT k AS w, lag(k) OVER (PARTITION BY txn ORDER BY lsn) AS h FROM l WHERE ty = 'error'),
e AS (SELECT DISTINCT w, h FROM p WHERE h IS NOT NULL),
r AS (SELECT w, h FROM e UNION SELECT r.w, e.h FROM r JOIN e ON r.h = e.w)
SELECT w AS node FROM r WHERE w = h
""")
def q35_wait_for_cycle(spark, d):
    place.checkpoints(spark)
    return graph.in_cycles(_edges(spark, d))


@query(f"WITH {LOG} SELECT lsn, k, last_value(CASE WHEN ty = 'purchase' THEN v END IGNORE NULLS) OVER (PARTITION BY k ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS seen FROM l")
def q36_read_your_writes(spark, d):
    return recovery.read_own_writes(log(spark, d), seq="lsn", write=F.col("ty") == "purchase").select("lsn", "k", "seen")


#: Tables of rising size, as the levels of a merge tree.
LEVELS = ("region", "supplier", "customer", "orders", "lineitem")


def _sizes(spark, d) -> DataFrame:
    """(name, level, items) of each of them."""
    each = [read(spark, d, t).agg(F.lit(t).alias("name"), F.lit(n).alias("level"), F.count("*").alias("items")) for n, t in enumerate(LEVELS)]
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out


SIZES = "t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, {n} AS level, count(*) AS items FROM {t}" for n, t in enumerate(LEVELS)) + ")"


@query(f"""
WITH {SIZES},
n AS (SELECT name, items, CASE WHEN items <= 400 THEN 1 ELSE greatest(1, ceil(sqrt(abs(ln(items / 1000.0) / ln(2.0))))) END AS levels FROM t)
SELECT name, items, CAST(levels AS INTEGER) AS levels, CAST(round(4.0 * pow(10.0 * pow(2.0, levels), 1.0) * pow(0.5, 1.0)) AS BIGINT) AS capacity1 FROM n
""")
def q37_compaction_policy(spark, d):
    n = _sizes(spark, d).select("name", "items").withColumn("levels", scalars.level_count(F.col("items")))
    return n.withColumn("capacity1", scalars.level_capacity(F.lit(1), F.col("levels")))


@query("""
WITH t AS (SELECT 'customer' AS name, count(*) AS items FROM customer UNION ALL SELECT 'orders', count(*) FROM orders),
b AS (SELECT name, items, CAST(ceil(items * ln(0.01::DOUBLE) / ln(1.0 / pow(2.0, ln(2.0)))) AS BIGINT) AS bits FROM t)
SELECT name, items, bits, CAST(round(bits / CAST(items AS DOUBLE) * ln(2.0)) AS INTEGER) AS hashes FROM b
""")
def q38_bloom_sizing(spark, d):
    each = [read(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("items")) for t in ("customer", "orders")]
    b = each[0].unionByName(each[1]).withColumn("bits", scalars.bloom_bits(F.col("items")))
    return b.withColumn("hashes", scalars.bloom_hashes(F.col("bits"), F.col("items")))


@query("SELECT sha256(lower(s_name || ':' || s_suppkey))[1:16] AS node_id, s_suppkey FROM supplier")
def q39_node_ids(spark, d):
    return read(spark, d, "supplier").select(scalars.node_id(F.concat("s_name", F.lit(":"), F.col("s_suppkey").cast("string"))).alias("node_id"), "s_suppkey")


@query(f"WITH {LOG} SELECT lsn, txn, k, v FROM l QUALIFY row_number() OVER (PARTITION BY txn ORDER BY lsn) <= 5")
def q40_savepoint(spark, d):
    return recovery.roll_back_to(log(spark, d), 5, seq="lsn").select("lsn", "txn", "k", "v")


@query("""SELECT 'server_version' AS name, '15.0' AS value""")
def q41_show(spark, d):
    return session.show(spark, "server_version").select(F.lit("server_version").alias("name"), F.col("server_version").alias("value"))


@query("SELECT c_custkey AS pk, c_mktsegment AS value, 'missing' AS problem FROM customer WHERE c_mktsegment = 'BUILDING'")
def q42_index_validate(spark, d):
    c = read(spark, d, "customer")
    return indexes.validate(indexes.build(c.filter("c_mktsegment <> 'BUILDING'"), ["c_mktsegment"], "c_custkey", indexes.CHUNKS), c, ["c_mktsegment"], "c_custkey")


@query(f"""
WITH {SIZES},
w AS (SELECT *, items * pow(0.5, (4 - level) * (5 - level) / 2.0) / pow(10.0, 4 - level) AS weight FROM t)
SELECT level, items, CAST(round(weight / (SELECT sum(weight) FROM w) * 8388608) AS BIGINT) AS bits,
       CASE WHEN level = 4 THEN 1.0 ELSE greatest(0.0001, pow(0.5, (4 - level) * (3 - level) / 2.0) / pow(10.0, 4 - level)) END::DOUBLE AS rate
FROM w
""")
def q43_bloom_budget(spark, d):
    levels, n = _sizes(spark, d), F.lit(len(LEVELS))
    weights = levels.agg(F.sum(scalars.bloom_weight(F.col("items"), F.col("level"), n)).alias("total"))
    # one row of totals
    return levels.join(F.broadcast(weights)).select("level", "items", scalars.bloom_budget(F.col("items"), F.col("level"), n, F.lit(8388608), F.col("total")).alias("bits"), scalars.bloom_rate(F.col("level"), n).alias("rate"))


@query("""
SELECT 't_seed_' || lpad(CAST(i AS VARCHAR), 4, '0') AS id, 'payload-' || lpad(CAST(i AS VARCHAR), 4, '0') || '-' || repeat('x', 24) AS payload
FROM range(256) r(i) WHERE i % 4 = 0
""")
def q44_seed_rows(spark, d):
    rows = seeds.seeds(spark, "t", 256)
    return rows.filter(dml.matches(rows, {"category": "hot", "status": "active"})).select("id", "payload")


@query(f"WITH {STATES} SELECT l.lsn, l.txn, l.k FROM l JOIN s ON l.txn = s.txn WHERE state = 'C' AND ty = 'view'")
def q45_committed_operations(spark, d):
    rows = log(spark, d)
    return rows.join(states(rows).filter("state = 'C'"), "txn", "left_semi").filter("ty = 'view'").select("lsn", "txn", "k")


@query(f"WITH {STATES} SELECT l.txn, lsn // 1000000 AS part, count(*) AS n, string_agg(CAST(lsn AS VARCHAR), ',' ORDER BY lsn) AS lsns FROM l JOIN s ON l.txn = s.txn WHERE state <> 'A' GROUP BY l.txn, lsn // 1000000")
def q46_redo_lists(spark, d):
    rows = log(spark, d)
    lists = recovery.redo_lists(rows, states(rows))
    return lists.select("txn", "part", F.size("lsns").cast("long").alias("n"), F.array_join(F.col("lsns").cast("array<string>"), ",").alias("lsns"))


# indexes as bytes, and filters

@query("""
SELECT c_nationkey AS value, printf('%08X', count(*)) || string_agg(printf('%08X', length(CAST(c_custkey AS VARCHAR))) || hex(CAST(c_custkey AS VARCHAR)), '' ORDER BY c_custkey) AS entry, count(*) AS n
FROM customer GROUP BY c_nationkey
""")
def q47_posting_codec(spark, d):
    coded = indexes.encoded(indexes.build(read(spark, d, "customer"), ["c_nationkey"], "c_custkey"))
    back = indexes.decoded(coded).select("value", F.size("pks").cast("long").alias("n"))
    return coded.select("value", F.hex("entry").alias("entry")).join(back, "value")


FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, [ord(c)::HUGEINT FOR c IN string_split({}, '')]), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"SELECT s_suppkey, CAST(h % 4294967296 AS BIGINT) AS low, CAST(h // 4294967296 AS BIGINT) AS high FROM (SELECT s_suppkey, {FNV.format('s_name')} AS h FROM supplier)")
def q48_fnv1a(spark, d):
    return read(spark, d, "supplier").withColumn("h", scalars.fnv1a(F.col("s_name"))).select("s_suppkey", "h.low", "h.high")


@query(f"""
WITH k AS (SELECT c_custkey AS key, CAST({FNV.format('CAST(c_custkey AS VARCHAR)')} AS HUGEINT) AS h FROM customer),
n AS (SELECT CAST(ceil(count(*) * ln(0.01::DOUBLE) / ln(1.0 / pow(2.0, ln(2.0)))) AS BIGINT) AS bits, count(*) AS items FROM k WHERE key % 2 = 0),
z AS (SELECT bits, CAST(round(bits / CAST(items AS DOUBLE) * ln(2.0)) AS BIGINT) AS hashes FROM n),
p AS (SELECT key, unnest([(h % 4294967296 + i * (h // 4294967296)) % bits FOR i IN range(hashes)]) AS pos FROM k, z),
s AS (SELECT DISTINCT pos FROM p WHERE key % 2 = 0)
SELECT p.key, bool_and(s.pos IS NOT NULL) AS maybe FROM p LEFT JOIN s ON p.pos = s.pos GROUP BY p.key
""")
def q49_bloom_test(spark, d):
    keys = read(spark, d, "customer").select("c_custkey")
    own = keys.filter("c_custkey % 2 = 0")
    size = bloom.sized(own.count())
    return bloom.might_hold(bloom.build(own, "c_custkey", *size), keys, "c_custkey", *size)


# beyond the reference: what SELECT gets from Spark SQL


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def x01_join_group(spark, d):
    for t in ("orders", "customer", "nation"):
        read(spark, d, t).createOrReplaceTempView(t)
    return spark.sql("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def x02_top_k(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import stateful  # noqa: F401  registers its queries

    return {n: f for n, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    from . import stateful  # noqa: F401

    return {n: sql for n, (_, sql) in _all.items()}
