"""Queries that go through sessions, stores and replicas: what statements, transactions, indexes, compaction and replay leave behind, beside the same in SQL.

Each works on a store of its own in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import dml, indexes, latency, recovery, replication
from ..sources import oplog, place
from ..sources.store import ConflictError, Store
from ..streaming.replay import Replica, read_records
from . import lexer
from .queries import LOG, STATES, log, query, read, states
from .session import Session

ORDERS = "CREATE TABLE o (o_orderkey BIGINT PRIMARY KEY, o_custkey INT, o_orderstatus TEXT NOT NULL, o_totalprice DOUBLE)"
CUSTOMERS = "CREATE TABLE c (c_custkey BIGINT PRIMARY KEY, c_mktsegment TEXT, c_acctbal DOUBLE, c_nationkey INT)"


def opened(spark, **more) -> Session:
    return Session(spark, place.fresh(spark, "db"), **more)


def orders(spark, d, **more) -> Session:
    """A session with the orders in table o."""
    s = opened(spark, **more)
    s.run(ORDERS)
    s.insert_rows("o", read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return s


def customers(spark, d, **more) -> Session:
    s = opened(spark, **more)
    s.run(CUSTOMERS)
    s.insert_rows("c", read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"))
    return s


def outcome(do, *args) -> str:
    """"done", or the kind of error."""
    try:
        do(*args)
    except (dml.ConstraintError, ConflictError) as e:
        return type(e).__name__
    return "done"


# statements


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_totalprice > 200000 OR o_orderstatus <> 'F' UNION ALL VALUES (-1, 1, 'N', 2.5), (-2, 2, 'it''s', 0.5)
""")
def q50_session_changes(spark, d):
    s = orders(spark, d)
    s.execute("UPDATE o SET o_orderstatus = 'X', o_totalprice = o_totalprice + 1 WHERE o_totalprice > 200000; DELETE FROM o WHERE o_orderstatus = 'F'; INSERT INTO o VALUES (-1, 1, 'N', 2.5), (-2, 2, 'it''s', 0.5)")
    return s.run("SELECT * FROM o").rows


@query("""
WITH n AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderkey = 7) AS k FROM orders)
SELECT unnest(generate_series(1, 13)) AS nth, unnest(['SET', 'BEGIN', 'UPDATE ' || p, 'DELETE ' || k, 'INSERT 0 2', 'ROLLBACK', 'CREATE INDEX', 'CREATE INDEX', 'DROP INDEX', 'BEGIN', 'DELETE ' || k, 'COMMIT', 'DROP TABLE']) AS tag FROM n
""")
def q51_command_tags(spark, d):
    s = orders(spark, d)
    done = s.execute("SET client_encoding = 'UTF8'; BEGIN; UPDATE o SET o_custkey = 0 WHERE o_orderstatus = 'P'; DELETE FROM o WHERE o_orderkey = 7; INSERT INTO o (o_orderkey, o_orderstatus) VALUES (-1, 'a;b'), (-2, 'c'); ROLLBACK; CREATE INDEX i ON o (o_custkey); CREATE INDEX IF NOT EXISTS i ON o (o_custkey); DROP INDEX i; BEGIN TRANSACTION; DELETE FROM o WHERE o_orderkey = 7; COMMIT; DROP TABLE IF EXISTS o")
    return spark.createDataFrame([(k + 1, r.tag) for k, r in enumerate(done)], "nth long, tag string")


@query("SELECT n_nationkey AS id, n_name || ' ''s; (a, b)' AS name, n_regionkey AS region FROM nation")
def q52_insert_literals(spark, d):
    """One INSERT of 25 rows of literals, nations being a fixed list."""
    rows = ", ".join(f"({r['n_nationkey']}, '{r['n_name']} ''s; (a, b)', {r['n_regionkey']})" for r in read(spark, d, "nation").limit(25).collect())
    s = opened(spark)
    s.execute(f'CREATE TABLE n ("ID" INT, name VARCHAR(80), region INTEGER NOT NULL, PRIMARY KEY (id)); INSERT INTO `n` VALUES {rows};')
    return s.run("SELECT id, name, region FROM n").rows


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_custkey AS VARCHAR) = '31' AND o_orderstatus = 'O'")
def q53_plain_conditions(spark, d):
    s = orders(spark, d, text_equality=True)
    return s.run("SELECT o_orderkey, o_totalprice FROM o WHERE o_custkey = 31 AND o_orderstatus = 'O' AND nothing = ''").rows


@query("""
WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10), lost AS (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
SELECT 'many' AS kind, o_custkey AS custkey, n FROM big UNION ALL SELECT 'none', c_custkey, 0 FROM lost
""")
def q54_with_and_sets(spark, d):
    s = orders(spark, d)
    s.run(CUSTOMERS)
    s.insert_rows("c", read(spark, d, "customer").select("c_custkey"))
    return s.run("WITH big AS (SELECT o_custkey, count(*) AS n FROM o GROUP BY o_custkey HAVING count(*) > 10), lost AS (SELECT c_custkey FROM c EXCEPT SELECT o_custkey FROM o) SELECT 'many' AS kind, o_custkey AS custkey, n FROM big UNION ALL SELECT 'none', c_custkey, 0 FROM lost").rows


@query("SELECT o_custkey AS custkey, count(*) AS orders, max(o_totalprice) AS highest FROM orders GROUP BY o_custkey")
def q55_insert_from_query(spark, d):
    s = orders(spark, d)
    s.execute("CREATE TABLE g (custkey INT PRIMARY KEY, orders INT, highest FLOAT8); INSERT INTO g SELECT o_custkey, count(*), max(o_totalprice) FROM o GROUP BY o_custkey")
    return s.run("SELECT * FROM g").rows


@query("""
SELECT unnest(['repeated key', 'key exists', 'null key', 'null status', 'no type', 'unique index', 'unique update', 'fits']) AS what,
       unnest(['ConstraintError', 'ConstraintError', 'ConstraintError', 'ConstraintError', 'ConstraintError', 'ConstraintError', 'ConstraintError', 'done']) AS outcome, (SELECT count(*) + 1 FROM orders) AS rows
""")
def q56_constraints(spark, d):
    s = orders(spark, d)
    s.execute("CREATE UNIQUE INDEX u ON o (o_orderkey, o_orderstatus)")
    tries = {
        "repeated key": "INSERT INTO o VALUES (-1, 1, 'a', 1), (-1, 2, 'b', 2)", "key exists": "INSERT INTO o VALUES (7, 1, 'a', 1)", "null key": "INSERT INTO o VALUES (NULL, 1, 'a', 1)",
        "null status": "INSERT INTO o VALUES (-1, 1, NULL, 1)", "no type": "INSERT INTO o VALUES (-1, 'one', 'a', 1)", "unique index": "CREATE UNIQUE INDEX v ON o (o_orderstatus)",
        "unique update": "UPDATE o SET o_orderstatus = NULL WHERE o_orderkey = 7", "fits": "INSERT INTO o VALUES (-1, 1, 'a', 1)",
    }
    got = [(what, outcome(s.run, sql)) for what, sql in tries.items()]
    return spark.createDataFrame(got, "what string, outcome string").withColumn("rows", F.lit(s.table("o").count()).cast("long"))


# transactions


@query("""
WITH n AS (SELECT count(*) AS all_, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders)
SELECT unnest(['inside', 'outside', 'after commit', 'rolled back', 'old version']) AS who, unnest([all_ - f + 1, all_, all_ - f + 1, all_ - f + 1, all_]) AS rows FROM n
""")
def q57_snapshots(spark, d):
    s = orders(spark, d)
    other, seen, before = Session(spark, s.store.root), {}, s.store.version()
    s.execute("BEGIN; DELETE FROM o WHERE o_orderstatus = 'F'; INSERT INTO o VALUES (-1, 1, 'a', 1)")
    seen["inside"], seen["outside"] = s.table("o").count(), other.table("o").count()
    s.run("COMMIT")
    seen["after commit"] = other.table("o").count()
    s.execute("BEGIN; DELETE FROM o; ROLLBACK")
    seen["rolled back"] = s.table("o").count()
    seen["old version"] = s.store.view(s.store.tables(before)["o"]).count()
    return spark.createDataFrame(list(seen.items()), "who string, rows long")


@query("SELECT unnest(['rows', 'index', 'other table']) AS what, unnest(['ConflictError', 'ConflictError', 'done']) AS outcome, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS rows")
def q58_conflicts(spark, d):
    """Of two transactions that change a table or its indexes, the second to commit fails; other tables do not matter.

    Two rows of our own see to it that each statement changes something, whatever the orders are: one that hits no row conflicts with nothing.
    """
    s = orders(spark, d)
    own = s.table("o").agg(F.least(F.min("o_orderkey"), F.lit(0))).first()[0] - 1  # below all keys
    s.run(f"INSERT INTO o VALUES ({own}, 1, 'N', 0), ({own - 1}, 1, 'P', 0)")
    other, got = Session(spark, s.store.root), []
    for what, theirs in (("rows", "DELETE FROM o WHERE o_orderstatus = 'P'"), ("index", "CREATE INDEX i ON o (o_custkey)"), ("other table", "CREATE TABLE t (id INT PRIMARY KEY)")):
        s.execute(f"BEGIN; UPDATE o SET o_custkey = -1 WHERE o_orderkey = {own}")
        other.run(theirs)
        got.append((what, outcome(s.run, "COMMIT")))
    return spark.createDataFrame(got, "what string, outcome string").withColumn("rows", F.lit(other.table("o").filter(F.col("o_orderkey") != own).count()).cast("long"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey % 5 <> 0 AND c_mktsegment <> 'BUILDING' GROUP BY c_mktsegment")
def q59_failed_statements(spark, d):
    """A statement that fails leaves the earlier ones of its transaction; the batch that it wrote is gone."""
    s = customers(spark, d)
    s.execute("BEGIN; DELETE FROM c WHERE c_custkey % 5 = 0")
    assert outcome(s.run, "INSERT INTO c (c_custkey) VALUES (1)") == "ConstraintError"
    s.execute("DELETE FROM c WHERE c_mktsegment = 'BUILDING'; COMMIT")
    return s.run("SELECT c_mktsegment, count(*) AS n FROM c GROUP BY c_mktsegment").rows


# indexes


MOVED = "CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END"


def _indexed(spark, d) -> Session:
    """Customers with an index on the segment, and changes since it was built."""
    s = customers(spark, d)
    s.execute("CREATE INDEX seg ON c (c_mktsegment); CREATE INDEX both ON c (c_nationkey, c_mktsegment); UPDATE c SET c_mktsegment = 'MOVED' WHERE c_custkey % 7 = 0; DELETE FROM c WHERE c_custkey % 11 = 0; INSERT INTO c VALUES (-1, 'BUILDING', 0, 1)")
    return s


@query(f"SELECT * FROM (SELECT c_custkey, {MOVED} AS c_mktsegment, c_acctbal, c_nationkey FROM customer WHERE c_custkey % 11 <> 0 UNION ALL VALUES (-1, 'BUILDING', 0.0, 1)) WHERE c_mktsegment = 'BUILDING'")
def q60_index_find(spark, d):
    return _indexed(spark, d).find("c", "seg", "BUILDING")


@query(f"SELECT c_custkey, {MOVED} AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 = 0 AND c_nationkey = 3")
def q61_index_find_two_columns(spark, d):
    return _indexed(spark, d).find("c", "both", [3, "MOVED"]).select("c_custkey", "c_mktsegment")


@query(f"SELECT value, count(*) AS n, min(k) AS lowest, max(k) AS highest FROM (SELECT c_custkey AS k, {MOVED} AS value FROM customer WHERE c_custkey % 11 <> 0 UNION ALL VALUES (-1, 'BUILDING')) GROUP BY value")
def q62_index_postings(spark, d):
    i = _indexed(spark, d).index("c", "seg")
    return i.select("value", F.explode("pks").alias("k")).groupBy("value").agg(F.count("*").alias("n"), F.min("k").alias("lowest"), F.max("k").alias("highest"))


@query("SELECT c_nationkey AS value, c_custkey AS pk FROM customer WHERE c_nationkey BETWEEN 3 AND 6")
def q63_index_range(spark, d):
    s = customers(spark, d)
    s.run("CREATE INDEX nat ON c (c_nationkey)")
    return indexes.lookup_range(s.index("c", "nat"), 3, 6)


@query("""
WITH v AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)
SELECT unnest(['built', 'compacted', 'cleared', 'reindexed']) AS what, unnest([count(*), count(*), 0, count(*)]) AS distinct_values, unnest([sum(n), sum(n), 0, sum(n) - (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0)])::BIGINT AS postings FROM v
""")
def q64_index_upkeep(spark, d):
    s = customers(spark, d)
    s.run("CREATE INDEX seg ON c (c_mktsegment)")
    made = s.index("c", "seg")
    parts = [("built", made), ("compacted", indexes.compact(made, 8)), ("cleared", indexes.clear(made))]
    s.execute("DELETE FROM c WHERE c_custkey % 2 = 0")
    s.reindex("c", "seg")
    parts.append(("reindexed", s.index("c", "seg")))
    out = [indexes.stats(i).select(F.lit(what).alias("what"), "distinct_values", F.col("postings").cast("long").alias("postings")) for what, i in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT unnest(['c_acctbal', 'c_mktsegment', 'c_nationkey']) AS c, unnest(['', 'both,seg', 'both']) AS covered")
def q65_index_catalog(spark, d):
    t = _indexed(spark, d).tables()["c"]
    return spark.createDataFrame([(c, ",".join(sorted(i.name for i in t.covering(c)))) for c in ("c_acctbal", "c_mktsegment", "c_nationkey")], "c string, covered string")


# the store


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, 1 AS batches FROM orders WHERE o_orderkey % 4 <> 0")
def q66_compaction(spark, d):
    s = orders(spark, d)
    s.execute("UPDATE o SET o_custkey = 4 WHERE o_orderkey % 3 = 0; DELETE FROM o WHERE o_orderkey % 4 = 0; UPDATE o SET o_custkey = 5 WHERE o_orderkey % 3 = 0")
    s.store.compact("o")
    return s.table("o").withColumn("batches", F.lit(len(s.tables()["o"].batches)))


@query("SELECT unnest([1, 2, 3, 4, 5, 6]) AS nth, unnest([2, 3, 1, 2, 3, 1]) AS batches, (SELECT count(*) FROM customer WHERE c_custkey NOT BETWEEN 1 AND 6) AS rows")
def q67_compaction_trigger(spark, d):
    """A commit that leaves more than three batches has the table compacted."""
    s, seen = customers(spark, d, compact_after=3), []
    for k in range(1, 7):
        s.run(f"DELETE FROM c WHERE c_custkey = {k}")
        seen.append((k, len(s.tables()["c"].batches)))
    return spark.createDataFrame(seen, "nth int, batches int").withColumn("rows", F.lit(s.table("c").count()).cast("long"))


@query("SELECT 'c' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'o', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def q68_live_counts(spark, d):
    s = orders(spark, d)
    s.run(CUSTOMERS)
    s.insert_rows("c", read(spark, d, "customer").select("c_custkey"))
    s.run("DELETE FROM o WHERE o_orderstatus = 'F'")
    return spark.createDataFrame([(n, s.store.count(n)) for n in sorted(s.tables())], "name string, rows long")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, 'duplicate key' AS problem FROM orders WHERE o_orderstatus = 'P' UNION ALL VALUES ('-5', 'deleted before inserted')")
def q69_validation(spark, d):
    """What a store finds in a table into which batches were put that no session would write."""
    s = orders(spark, d)
    t, rows = s.store.tables()["o"], s.table("o")
    s.store.write_batch(t, rows.filter("o_orderstatus = 'P'"), "A", t.last() + 1)
    s.store.write_batch(t, rows.limit(1).withColumn("o_orderkey", F.lit(-5).cast("long")).withColumn("_op", F.lit("D")), "U", t.last() + 1)
    s.store.publish({"o": t}, s.store.version(), {"o"})
    return s.store.problems("o")


@query("SELECT 'c' AS table_name, CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT 'o', CAST(o_orderkey AS VARCHAR) FROM orders")
def q70_store_scan(spark, d):
    s = orders(spark, d)
    s.run(CUSTOMERS)
    s.insert_rows("c", read(spark, d, "customer").select("c_custkey"))
    return Store(spark, s.store.root).scan_all()


# logs, replicas and replication


@query(f"WITH {LOG} SELECT txn, lsn % 20 AS nth, CASE WHEN ty = 'purchase' THEN 'w' ELSE 'r' END AS f, CAST(k AS VARCHAR) AS k, last_value(CASE WHEN ty = 'purchase' THEN CAST(lsn AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY lsn ROWS UNBOUNDED PRECEDING) AS v FROM l")
def q71_json_transactions(spark, d):
    """Events as transactions in JSON lines: written, read, answered, written and read again."""
    ops = log(spark, d).select("txn", "lsn", F.when(F.col("ty") == "purchase", "w").otherwise("r").alias("f"), F.col("k").cast("string").alias("k"))
    op = F.array("f", "k", F.when(F.col("f") == "w", F.col("lsn").cast("string")))
    lists = ops.groupBy("txn").agg(F.transform(F.sort_array(F.collect_list(F.struct("lsn", op.alias("op")))), lambda x: x["op"]).alias("ops"))
    into, out = place.fresh(spark, "ops"), place.fresh(spark, "answers")
    lists.write.json(into)
    oplog.write_results(recovery.read_own_writes(oplog.read_ops(spark, into)), out)
    rows = spark.read.schema(oplog.SCHEMA).json(out).select("txn", F.posexplode("ops").alias("nth", "op"))
    return rows.select("txn", "nth", F.col("op")[0].alias("f"), F.col("op")[1].alias("k"), F.get("op", F.lit(2)).alias("v"))


@query("SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY event_type")
def q72_report(spark, d):
    out = place.fresh(spark, "report")
    latency.report(latency.summary(read(spark, d, "events"), "event_type", "value"), out)
    return spark.read.json(out).select("event_type", "n", "min", "max")


def _records(spark, d) -> DataFrame:
    """Events as a change log: errors delete their user's key, others put it; a transaction's last event ends it."""
    rows = log(spark, d)
    kind = F.when(F.col("ty") == "error", "DELETE").otherwise("PUT")
    ops = rows.select((F.col("lsn") * 2).alias("seq"), "txn", kind.alias("type"), F.lit(None).cast("string").alias("table"), F.col("k").cast("string").alias("key"), F.col("lsn").cast("string").alias("value"))
    ends = states(rows).filter("state <> 'I'")
    nothing = F.lit(None).cast("string")
    return ops.unionByName(ends.select((F.col("last_lsn") * 2 + 1).alias("seq"), "txn", F.when(F.col("state") == "C", "COMMIT").otherwise("ABORT").alias("type"), nothing.alias("table"), nothing.alias("key"), nothing.alias("value")))


REPLAYED = f"WITH {STATES} SELECT CAST(k AS VARCHAR) AS key, CAST(lsn AS VARCHAR) AS value FROM (SELECT * FROM l JOIN s ON l.txn = s.txn WHERE state = 'C' QUALIFY row_number() OVER (PARTITION BY k ORDER BY last_lsn DESC, lsn DESC) = 1) WHERE ty <> 'error'"


@query(REPLAYED)
def q73_replay_late_operations(spark, d):
    """Three micro-batches, dealt so that most operations come after their COMMIT, and one of them twice."""
    into = place.fresh(spark, "log")
    _records(spark, d).withColumn("part", F.when(F.col("type").isin("COMMIT", "ABORT"), 0).otherwise(F.pmod(F.xxhash64("seq"), F.lit(3)))).write.parquet(into)
    r, rows = Replica(spark, place.fresh(spark, "replica"), compact_after=2), spark.read.parquet(into)
    for k in (0, 1, 1, 2):
        r.apply(rows.filter(F.col("part") == k), k)
    return r.view()


@query(REPLAYED)
def q74_replay_stream(spark, d):
    into = place.fresh(spark, "log")
    _records(spark, d).repartition(2).write.parquet(into)
    r = Replica(spark, place.fresh(spark, "replica"))
    r.follow(read_records(spark, into), place.fresh(spark, "stream")).awaitTermination()
    return r.view()


@query("SELECT n_nationkey AS id, n_name AS name, 'i' AS indexes FROM nation WHERE n_nationkey % 2 = 0")
def q75_replica_catalog(spark, d):
    """A log that makes, drops and makes again a table, with rows before and after; DDL that comes twice does no harm."""
    made = '{"columns": {"id": "INT", "name": "TEXT"}, "primary_key": "id"}'
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    value = F.to_json(F.struct("id", "name"))

    def puts(first: int, txn: int, where: str) -> DataFrame:
        return rows.filter(where).select((F.lit(first) + F.col("id")).cast("long").alias("seq"), F.lit(txn).cast("long").alias("txn"), F.lit("PUT").alias("type"), F.lit("n").alias("table"), F.col("id").cast("string").alias("key"), value.alias("value"))

    def records(*these) -> DataFrame:
        return spark.createDataFrame([(*t, *[None] * (6 - len(t))) for t in these], "seq long, txn long, type string, table string, key string, value string")

    r = Replica(spark, place.fresh(spark, "replica"))
    r.apply(records((1, 1, "CREATE_TABLE", "n", None, made), (2, 1, "COMMIT")).unionByName(puts(100, 2, "id >= 0")), 0)
    again = records((200, 2, "COMMIT"), (300, 3, "DROP_TABLE", "n"), (301, 3, "CREATE_TABLE", "n", None, made), (302, 3, "CREATE_INDEX", "n", "i", '{"columns": ["name"]}'), (303, 3, "CREATE_INDEX", "n", "i", '{"columns": ["name"]}'), (304, 3, "COMMIT"), (700, 5, "DROP_TABLE", "n"), (701, 5, "ABORT"))
    r.apply(again.unionByName(puts(400, 4, "id % 2 = 0")), 1)
    r.apply(records((1, 1, "CREATE_TABLE", "n", None, made), (600, 4, "COMMIT")), 2)
    names = ",".join(sorted(r.catalog()["n"][0].indexes))
    return r.table("n").withColumn("indexes", F.lit(names))


@query(f"WITH {LOG}, m AS (SELECT *, max(lsn % 97) OVER (PARTITION BY k ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM l) SELECT lsn, k, lsn % 97 AS term FROM m WHERE lsn % 97 < seen")
def q76_stale_terms(spark, d):
    messages = log(spark, d).select("lsn", "k", (F.col("lsn") % 97).alias("term"))
    return replication.stale_terms(messages, seq="lsn", term="term", node="k")


@query(f"""
WITH {LOG}, r AS (SELECT txn, count(*) AS replicas, count(*) FILTER (WHERE ty <> 'error') AS acks FROM l GROUP BY txn), m AS (SELECT unnest(['local', 'async', 'sync', 'quorum']) AS mode)
SELECT mode, count(*) AS txns, count(*) FILTER (WHERE acks >= CASE mode WHEN 'sync' THEN replicas WHEN 'quorum' THEN least(18, replicas) ELSE 0 END) AS ok FROM r, m GROUP BY mode
""")
def q77_replication_modes(spark, d):
    acks = log(spark, d).withColumn("ack", F.col("ty") != "error")
    each = [replication.outcomes(acks, m, min_acks=18).agg(F.lit(m).alias("mode"), F.count("*").alias("txns"), F.count_if("ok").alias("ok")) for m in replication.MODES]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


# words


@query("SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, CAST(c_acctbal AS VARCHAR), c_custkey) AS place, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0, c_custkey) AS by_sign FROM customer")
def q78_typed_order(spark, d):
    """Numbers with fractions and truth values kept as text sort by value."""
    c = read(spark, d, "customer")
    money, sign = F.concat(F.lit(" "), F.col("c_acctbal").cast("string")), (F.col("c_acctbal") > 0).cast("string")
    by = Window.partitionBy("c_nationkey")
    return c.select("c_custkey", F.row_number().over(by.orderBy(*scalars.typed_order(money, "double"), "c_custkey")).alias("place"), F.row_number().over(by.orderBy(*scalars.typed_order(sign, "boolean"), "c_custkey")).alias("by_sign"))


@query("SELECT unnest(['customer', 'nation', 'orders']) AS name, unnest([3, 1, 2]) AS by_words, unnest([2, 3, 1]) AS by_parser")
def q79_table_names(spark, d):
    """The tables that a statement names, as the words say and as Spark's parser does."""
    sql = "SELECT n.n_name FROM nation n, orders AS o JOIN customer c ON c.c_custkey = o.o_custkey WHERE n.n_nationkey = c.c_nationkey"
    words, parsed = lexer.table_names(sql), lexer.plan_tables(spark, "SELECT 1 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
    return spark.createDataFrame([(n, words.index(n) + 1, parsed.index(n) + 1) for n in sorted(words)], "name string, by_words int, by_parser int")
