import os
import random
import time

import pytest
from pyspark.sql import functions as F

from driftwell.functions import scalars
from driftwell.functions.types import identifier, spark_type
from driftwell.operators import dml, graph, indexes, latency, recovery, replication, snapshot
from driftwell.plans import lexer
from driftwell.plans import queries as core
from driftwell.plans.session import Session, StatementError
from driftwell.sources import oplog
from driftwell.sources.catalog import CatalogError
from driftwell.sources.store import ConflictError, Store
from driftwell.streaming.replay import Replica, read_records


@pytest.fixture
def s(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}")


def rows(result):
    return [tuple(r) for r in result.rows.collect()]


def test_create_insert_select_update_delete(s):
    tags = [r.tag for r in s.execute("CREATE TABLE users (id TEXT PRIMARY KEY, name TEXT); INSERT INTO users VALUES ('1', 'O''Hara; x'); INSERT INTO users (name, id) VALUES ('b', '2'), ('c', '3')")]
    assert tags == ["CREATE TABLE", "INSERT 0 1", "INSERT 0 2"]
    assert rows(s.run("SELECT * FROM users")) == [("1", "O'Hara; x"), ("2", "b"), ("3", "c")]
    assert s.run("UPDATE users SET name = 'z' WHERE id = '2'").tag == "UPDATE 1"
    assert s.run("UPDATE users SET name = 'q' WHERE id = 'none'").tag == "UPDATE 0"
    assert s.run("DELETE FROM users WHERE id = '1'").tag == "DELETE 1"
    assert rows(s.run("SELECT name FROM users WHERE id = '2'")) == [("z",)]
    assert s.run("INSERT INTO users VALUES ('1', 'again')").tag == "INSERT 0 1"
    assert rows(s.run("SELECT * FROM users")) == [("1", "again"), ("2", "z"), ("3", "c")]
    assert s.run("DELETE FROM users").tag == "DELETE 3" and rows(s.run("SELECT * FROM users")) == []


def test_typed_key_order_duplicate_key_and_constraints(s):
    s.execute("CREATE TABLE metrics (id INT PRIMARY KEY, value TEXT NOT NULL); INSERT INTO metrics VALUES (10, 'a'), (2, 'b')")
    assert rows(s.run("SELECT * FROM metrics")) == [(2, "b"), (10, "a")]
    for bad in ("INSERT INTO metrics VALUES (2, 'x')", "INSERT INTO metrics VALUES (3, NULL)", "INSERT INTO metrics VALUES ('x', 'y')", "INSERT INTO metrics (id, nope) VALUES (4, 'x')", "INSERT INTO metrics VALUES (7, 'a'), (7, 'b')", "UPDATE metrics SET id = 5", "UPDATE metrics SET nope = 5"):
        with pytest.raises(dml.ConstraintError):
            s.run(bad)
    with pytest.raises(StatementError):
        s.run("INSERT INTO metrics VALUES (5)")
    assert s.run("UPDATE metrics SET value = concat(value, '!')").tag == "UPDATE 2"
    assert rows(s.run("SELECT value FROM metrics WHERE id = 10")) == [("a!",)]


def test_transactions_roll_back_and_isolate(s, spark, tmp_path):
    s.run("CREATE TABLE t (id BIGINT PRIMARY KEY, v TEXT)")
    other = Session(spark, f"file://{tmp_path}")
    s.execute("BEGIN; INSERT INTO t VALUES (1, 'a')")
    assert rows(s.run("SELECT * FROM t")) == [(1, "a")] and rows(other.run("SELECT * FROM t")) == []
    s.run("ROLLBACK")
    assert rows(s.run("SELECT * FROM t")) == []
    s.execute("BEGIN TRANSACTION; INSERT INTO t VALUES (1, 'a'); UPDATE t SET v = 'b'; COMMIT")
    assert rows(other.run("SELECT * FROM t")) == [(1, "b")]
    for bad in ("COMMIT", "ROLLBACK"):
        with pytest.raises(StatementError):
            s.run(bad)
    s.run("BEGIN")
    with pytest.raises(StatementError):
        s.run("BEGIN")
    s.run("UPDATE t SET v = 'mine'")
    other.run("UPDATE t SET v = 'theirs'")
    with pytest.raises(ConflictError):
        s.run("COMMIT")
    assert rows(s.run("SELECT v FROM t")) == [("theirs",)]


def test_a_failed_statement_keeps_earlier_ones(s):
    with pytest.raises(StatementError):
        s.execute("CREATE TABLE a (id TEXT PRIMARY KEY); FLY ME; CREATE TABLE b (id TEXT PRIMARY KEY)")
    assert set(s.tables()) == {"a"}
    s.run("BEGIN")
    s.run("INSERT INTO a VALUES ('1')")
    with pytest.raises(dml.ConstraintError):
        s.run("INSERT INTO a VALUES ('1')")
    s.run("COMMIT")
    assert rows(s.run("SELECT * FROM a")) == [("1",)]


def test_if_exists_matrix_and_drop(s):
    s.run("CREATE TABLE p (id TEXT PRIMARY KEY, name TEXT)")
    s.run("CREATE TABLE IF NOT EXISTS p (id TEXT PRIMARY KEY)")
    assert s.tables()["p"].schema.names == ["id", "name"]
    with pytest.raises(CatalogError):
        s.run("CREATE TABLE p (id TEXT PRIMARY KEY)")
    s.execute("CREATE INDEX i ON p (name); CREATE INDEX IF NOT EXISTS i ON p (name); DROP INDEX i; DROP INDEX IF EXISTS i")
    for bad in ("DROP INDEX i", "CREATE INDEX i ON nope (x)", "CREATE INDEX i ON p (nope)", "CREATE TABLE q (id TEXT)", "CREATE TABLE q (a TEXT, b TEXT, PRIMARY KEY (a, b))", "CREATE TABLE q (id TEXT PRIMARY KEY, id TEXT)", "DROP TABLE nope"):
        with pytest.raises(CatalogError):
            s.run(bad)
    s.execute("INSERT INTO p VALUES ('1', 'x'); DROP TABLE p; DROP TABLE IF EXISTS p; CREATE TABLE p (id TEXT, name TEXT, PRIMARY KEY (id))")
    assert rows(s.run("SELECT * FROM p")) == []


def test_unique_index(s):
    s.execute("CREATE TABLE u (id INT PRIMARY KEY, email TEXT); CREATE UNIQUE INDEX e ON u (email); INSERT INTO u VALUES (1, 'a'), (2, 'b'), (3, NULL), (4, NULL)")
    for bad in ("INSERT INTO u VALUES (5, 'a')", "UPDATE u SET email = 'z'", "UPDATE u SET email = 'b' WHERE id = 1"):
        with pytest.raises(dml.ConstraintError):
            s.run(bad)
    assert s.run("UPDATE u SET email = 'c' WHERE id = 1").tag == "UPDATE 1"
    assert sorted((r["value"], r["pks"]) for r in s.index("u", "e").collect()) == [("b", [2]), ("c", [1])]
    s.execute("INSERT INTO u VALUES (6, 'a')")
    with pytest.raises(dml.ConstraintError):
        s.execute("UPDATE u SET email = 'same' WHERE id > 4; INSERT INTO u VALUES (7, 'same')")


def test_compaction_keeps_rows_and_old_versions(s, spark, tmp_path):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT); INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c'); DELETE FROM t WHERE id = 2; UPDATE t SET v = 'z' WHERE id = 3")
    store = Store(spark, f"file://{tmp_path}")
    before = store.version()
    store.compact("t")
    assert len(store.tables()["t"].batches) == 1 and rows(s.run("SELECT * FROM t")) == [(1, "a"), (3, "z")]
    assert sorted(map(tuple, store.view(store.tables(before)["t"]).collect())) == [(1, "a"), (3, "z")]
    s.run("INSERT INTO t VALUES (2, 'new')")
    assert rows(s.run("SELECT * FROM t")) == [(1, "a"), (2, "new"), (3, "z")]
    assert sorted(map(tuple, store.scan_all().collect())) == [("t", "1"), ("t", "2"), ("t", "3")]
    assert store.problems("t").count() == 0 and store.compact_if("t") is None and store.compact_if("t", runs=1)
    t = store.tables()["t"]
    store.write_batch(t, spark.createDataFrame([(1, "twice")], "id long, v string"), "A", 9)
    store.publish({"t": t}, store.version(), {"t"})
    assert [tuple(r) for r in store.problems("t").collect()] == [("1", "duplicate key")]


def test_show_set_and_literals(s):
    assert s.run("SET x = 1").tag == "SET" and s.run("SHOW server_version").rows.first()["server_version"] == "15.0" and s.run("SHOW nothing").rows.first()[0] == ""
    assert rows(s.run("SELECT 1+1")) == [("1+1",)] and rows(s.run("SELECT 'it''s'")) == [("it's",)]


@pytest.mark.parametrize(("where", "want"), [("a = 5", 1), ("a >= 5", 0), ("a <> 5", None), ("a != 5", 0), ("a LIKE 'x'", None), ("a IN (1)", None), ("a BETWEEN 1 AND 2", None), ("a=5 OR b='x'", 0), ("(a=5) AND (b='x')", 0), ("nope = 'x'", 0), ("nope = ''", 2), ("b='x' ORDER BY a", 0), ("b = NULL", 1), ("b = ''", 1), ("a = 5 AND a = 6", 1), ("a = '5' AND b = 'x and y'", 1)])
def test_plain_conditions(spark, tmp_path, where, want):
    s = Session(spark, f"file://{tmp_path}", text_equality=True)
    s.execute("CREATE TABLE t (a INT PRIMARY KEY, b TEXT); INSERT INTO t VALUES (5, 'x and y'), (6, NULL)")
    if want is None:
        with pytest.raises(ValueError):
            s.run(f"SELECT * FROM t WHERE {where}")
    else:
        assert s.run(f"SELECT a FROM t WHERE {where}").rows.count() == want


def test_select_is_spark_sql(s):
    s.execute("CREATE TABLE a (id INT PRIMARY KEY, g TEXT); CREATE TABLE b (id INT PRIMARY KEY, x DOUBLE PRECISION); INSERT INTO a VALUES (1, 'p'), (2, 'p'); INSERT INTO b VALUES (1, 1.5), (2, 2)")
    assert rows(s.run("SELECT g, sum(x) AS x, count(*) AS n FROM a JOIN b ON a.id = b.id GROUP BY g")) == [("p", 3.5, 2)]


def test_point_lookup_reaches_the_scan(s):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, v TEXT, w TEXT); INSERT INTO t VALUES (1, 'a', 'b')")
    plan = s.run("SELECT v FROM t WHERE id = 1").rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,1)" in plan and "w:string" not in plan and "Exchange" not in plan


def test_newest_wins_is_like_a_dict(spark):
    rng, want, log = random.Random(4), {}, []
    for seq in range(500):
        k, op = f"k{rng.randrange(40)}", rng.choice("PPPD")
        log.append((seq, op, k, str(seq)))
        want.pop(k, None) if op == "D" else want.__setitem__(k, str(seq))
    df = spark.createDataFrame(log, "seq long, op string, key string, value string")
    assert {r["key"]: r["value"] for r in snapshot.live(df, ["key"], ["seq"]).collect()} == want
    half = snapshot.compact(df.filter("seq < 250"), ["key"], ["seq"], full=False)
    again = snapshot.compact(half.unionByName(df.filter("seq >= 250")), ["key"], ["seq"])
    assert {r["key"]: r["value"] for r in again.collect()} == want
    with pytest.raises(ValueError):
        snapshot.key_range(df, "key", "b", "a")
    assert snapshot.key_range(df, "key", "k1", "k2").filter("key > 'k2'").isEmpty()


def test_postings(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "pk long, v string")
    i = indexes.build(t, ["v"], "pk")
    assert {r["value"]: r["pks"] for r in i.collect()} == {"a": [1, 2], "b": [3]}
    j = indexes.remove(indexes.add(i, spark.createDataFrame([("b", 9), ("a", 1)], "value string, pk long")), spark.createDataFrame([("b", 3), ("a", 2)], "value string, pk long"))
    assert {r["value"]: r["pks"] for r in j.collect()} == {"a": [1], "b": [9]}
    assert sorted((r["value"], r["pk"], r["problem"]) for r in indexes.validate(j, t, ["v"], "pk").collect()) == [("a", 2, "missing"), ("b", 3, "missing"), ("b", 9, "stale")]
    assert tuple(indexes.stats(i).first()) == (2, 3, 2)
    assert sorted(r["pk"] for r in indexes.lookup_range(i, "a", "b").collect()) == [1, 2, 3]


@pytest.mark.parametrize("chunks", [1, 7, 64])
def test_postings_are_like_a_dict(spark, chunks):
    rng, want = random.Random(chunks), {}
    index = indexes.build(spark.createDataFrame([], "pk long, v string"), ["v"], "pk", chunks)
    for turn in range(4):
        new = [(rng.choice("abc"), rng.randrange(30)) for _ in range(25)]
        gone = [(rng.choice("abc"), rng.randrange(30)) for _ in range(12)]
        for v, k in new:
            want.setdefault(v, set()).add(k)
        for v, k in gone:
            want.get(v, set()).discard(k)
        made = lambda x: spark.createDataFrame(x, "value string, pk long")
        index = indexes.remove(indexes.add(index, made(new), chunks), made(gone))
        index = spark.createDataFrame(index.collect(), index.schema)
        rows = index.collect()
        assert len({(r["value"], r["part"]) for r in rows}) == len(rows) and all(r["pks"] == sorted(set(r["pks"])) for r in rows)
        got = {}
        for r in rows:
            assert not got.setdefault(r["value"], set()) & set(r["pks"])
            got[r["value"]] |= set(r["pks"])
        assert got == {v: k for v, k in want.items() if k}
    assert sorted(r["pk"] for r in indexes.lookup(index, "a").collect()) == sorted(want["a"])
    assert {r["value"]: r["pks"] for r in indexes.decoded(indexes.encoded(indexes.compact(index, 1))).collect()} == {v: [str(x) for x in sorted(k)] for v, k in want.items() if k}
    assert indexes.clear(index).count() == 0


def test_long_lists_are_decoded_in_time(spark):
    """Time follows the keys, here as many as a nation has at 60 times sf0.1."""
    index = indexes.build(spark.range(36_000).withColumn("v", F.lit("a")), ["v"], "id")
    coded = spark.createDataFrame(indexes.encoded(index).collect(), "value string, part int, entry binary")
    began = time.time()
    assert indexes.decoded(coded).first()["pks"] == [str(k) for k in range(36_000)]
    assert time.time() - began < 20


def test_lists_of_any_length_are_decoded(spark):
    texts = {n: [("", "é", "key", "x" * 300)[k % 4] + str(k) * (k % 3) for k in range(n)] for n in (0, 1, 2, 7, 8, 9, 26, 27, 28, 1000)}
    index = spark.createDataFrame([(n, 0, k) for n, k in texts.items()], "value int, part int, pks array<string>")
    assert {r["value"]: r["pks"] for r in indexes.decoded(indexes.encoded(index)).collect()} == texts
    for bad in (b"", b"\0\0\0\1", b"\0\0\0\1\0\0\0\2a", b"\0\0\0\1\0\0\0\1ab", b"\0\0\0\3\0\0\0\0\0\0\0\0", b"\x7f\xff\xff\xff\0\0\0\0"):
        with pytest.raises(Exception, match="ends within a key"):
            indexes.decoded(spark.createDataFrame([(1, 0, bad)], "value int, part int, entry binary")).collect()


def test_written_postings_follow_the_table(s, spark):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY, g TEXT, n INT); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 1), (3, NULL, 1); CREATE INDEX g ON t (g); CREATE INDEX gn ON t (g, n)")
    assert s.tables()["t"].indexes["g"].path and len(s.store.read_postings(s.tables()["t"], s.tables()["t"].indexes["g"]).collect()) == 2
    s.execute("UPDATE t SET g = 'b' WHERE id = 1; DELETE FROM t WHERE id = 2; INSERT INTO t VALUES (4, 'a', 2), (2, 'a', 2)")
    for _ in range(2):
        assert sorted((r["value"], r["pks"]) for r in s.index("t", "g").collect()) == [("a", [2, 4]), ("b", [1])]
        assert sorted(r["id"] for r in s.find("t", "g", "a").collect()) == [2, 4] and s.find("t", "g", "zzz").count() == 0
        assert [r["id"] for r in s.find("t", "gn", ["b", 1]).collect()] == [1] and s.find("t", "gn", ["b", 2]).count() == 0
        s.reindex("t", "g")
        s.compact("t")
    plan = s.find("t", "g", "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value,a)" in plan


def test_statements_that_do_not_read(s):
    s.run("CREATE TABLE t (id INT(11) PRIMARY KEY, v VARCHAR(3) DEFAULT 'x' NOT NULL)")
    assert [f.simpleString() for f in s.tables()["t"].schema] == ["id:bigint", "v:string"] and not s.tables()["t"].schema["v"].nullable
    for bad in ("CREATE TABLE", "CREATE TABLE x", "CREATE TABLE x (id)", "CREATE VIEW x", "DROP t", "DROP TABLE t u", "CREATE INDEX i ON t ()", "CREATE INDEX i t (v)", "INSERT t VALUES (1, 'a')", "INSERT INTO t (1, 'a')", "INSERT INTO t VALUES (1, 'a') (2, 'b')", "INSERT INTO t VALUES (1, 'a'", "UPDATE t v = 1", "UPDATE t SET v", "DELETE t", "DELETE FROM t id = 1"):
        with pytest.raises(StatementError):
            s.run(bad)
    assert s.run("insert into t values (1, 'it''s (a, b); where')").tag == "INSERT 0 1" and s.run("update t set v = 'where' where v = 'it''s (a, b); where'").tag == "UPDATE 1"


def test_queries_with_names_of_their_own(s, spark):
    s.execute("CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t VALUES (1), (2)")
    spark.range(5).createOrReplaceTempView("t")
    assert rows(s.run("WITH x AS (SELECT id FROM t WHERE id > 1) SELECT x.id FROM x JOIN t ON x.id = t.id")) == [(2,)]
    assert spark.table("t").count() == 5
    spark.catalog.dropTempView("t")
    s.run("SELECT id FROM t WHERE id = 1 ORDER BY id")
    assert not spark.catalog.tableExists("t")


def test_insert_computes_its_rows_once(s, spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    s.execute("CREATE TABLE t (id INT PRIMARY KEY, u INT NOT NULL); CREATE UNIQUE INDEX i ON t (u)")
    s.insert_rows("t", spark.range(100).selectExpr("id", "id + 1 AS u").mapInPandas(counted, "id long, u long"))
    assert seen.value == 100
    files = lambda: s.store._fs.listStatus(s.store._path("t"))
    before = len(files())
    with pytest.raises(dml.ConstraintError):
        s.run("INSERT INTO t VALUES (200, 5)")
    assert len(files()) == before


def test_recovery_orders_by_commit(spark):
    log = spark.createDataFrame([(1, 1, "k", "PUT", "a"), (2, 2, "k", "PUT", "b"), (3, 2, None, "COMMIT", None), (4, 1, None, "COMMIT", None), (5, 3, "k", "PUT", "lost")], "lsn long, txn long, k string, ty string, v string")
    st = recovery.transaction_states(log, F.when(F.col("ty") == "COMMIT", "C").otherwise("I"))
    ops = log.filter("ty = 'PUT'")
    assert recovery.replay(ops, st).first()["v"] == "a"
    assert {(r["txn"], r["k"], r["restore"]) for r in recovery.undo(ops, st, ["I"]).collect()} == {(3, "k", "b")}


def test_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (7, 8)], "waiter long, holder long")
    assert sorted(r["node"] for r in graph.in_cycles(e).collect()) == [1, 2, 3, 6]
    assert sorted(r["node"] for r in graph.in_cycles(e, longest=2).collect()) == [6]


def test_cycles_of_any_length(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rng = random.Random(2)
    pairs = {(i, (i + 1) % 9) for i in range(9)} | {(9, 0), (10, 10), (3, 11)} | {(rng.randrange(20, 60), rng.randrange(20, 60)) for _ in range(45)}
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    e = spark.createDataFrame(sorted(pairs), "waiter long, holder long")
    assert sorted(r["node"] for r in graph.in_cycles(e).collect()) == sorted(a for a, b in reach if a == b)


def test_registered_cycles_have_no_bound(spark):
    """The edges of sf0.01, rebuilt and searched in plain Python."""
    d, last, edges = "/root/testdata/sf0.01", {}, {}
    for r in spark.read.parquet(f"{d}/events.parquet").filter("event_type = 'error'").orderBy("event_id").collect():
        txn = r["event_id"] // 20
        if txn in last:
            edges.setdefault(r["user_id"], set()).add(last[txn])
        last[txn] = r["user_id"]

    def reaches_itself(start):
        seen, todo = set(), [start]
        while todo:
            for x in edges.get(todo.pop(), ()):
                if x == start:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return False

    want = sorted(n for n in edges if reaches_itself(n))
    got = sorted(r["node"] for r in core.queries()["q35_wait_for_cycle"](spark, d).collect())
    assert got == want and len(got) > graph.in_cycles(core._edges(spark, d), longest=3).count()


def test_long_cycles(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    ring = lambda first, n: [(first + i, first + (i + 1) % n) for i in range(n)]
    e = spark.createDataFrame(ring(0, 4) + ring(100, 50) + [(3, 100), (149, 200), (200, 201)], "waiter long, holder long")
    assert sorted(r["node"] for r in graph.in_cycles(e).collect()) == [*range(4), *range(100, 150)]


def test_whole_scan_reads_every_table(spark):
    d = "/root/testdata/sf0.001"
    names = sorted(f.removesuffix(".parquet") for f in os.listdir(d) if f.endswith(".parquet"))
    got = {r["table_name"]: r["count"] for r in core.queries()["q23_whole_db_scan"](spark, d).groupBy("table_name").count().collect()}
    assert got == {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in names}


def test_floor_rank_and_summary(spark):
    df = spark.range(128).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert df.agg(scalars.floor_rank(F.col("v"), 0.95)).first()[0] == 120
    r = latency.summary(df.unionByName(df), "g", "v").first()
    assert (r["n"], r["p50"], r["p95"], r["min"], r["max"]) == (256, 63.0, 121.0, 0.0, 127.0)


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_of_ranges(spark, seed):
    """Against sorting, with outliers, ties, signs, infinities and a null group."""
    rng = random.Random(seed)
    values = {"u": [rng.random() * 1000 for _ in range(997)], "t": [1.0] * 500, None: [rng.gauss(0, 1e-3) for _ in range(301)], "e": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(200)] + [float("inf"), float("-inf")], "one": [7.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in [*vs, None]], "g string, v double")
    got = {r["g"]: r for r in latency.summary(df, "g", "v").collect()}
    for g, vs in values.items():
        vs = sorted(vs)
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(vs), vs[0], vs[-1])
        assert [got[g][k] for k in latency.RANKS] == [vs[int((len(vs) - 1) * p)] for p in latency.RANKS.values()]
    assert latency.summary(df.limit(0), "g", "v").count() == 0


def test_fnv1a(spark):
    def plain(b):
        h = 0xCBF29CE484222325
        for x in b:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h

    texts = ["", "a", "foobar", "é日", "x" * 300, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.fnv1a(F.col("t")).alias("h")).collect()
    assert [(r["h"]["high"] << 32) + r["h"]["low"] for r in got] == [plain((t or "").encode()) for t in texts] and plain(b"foobar") == 0x85944171F73967E8


def test_quorum(spark):
    a = spark.createDataFrame([(1, True), (1, False), (1, True), (2, True), (3, False), (3, True)], "txn long, ack boolean")
    got = {r["txn"]: r["ok"] for r in replication.outcomes(a).collect()}
    assert got == {1: True, 2: True, 3: False}
    assert not replication.outcomes(a, "sync").filter("txn = 1").first()["ok"] and replication.outcomes(a, "async").filter("txn = 3").first()["ok"]
    m = spark.createDataFrame([(1, 1, "a"), (2, 3, "a"), (3, 2, "a")], "seq long, term long, node string")
    assert [r["seq"] for r in replication.stale_terms(m).collect()] == [3]


def test_stream_replay_is_idempotent(spark, tmp_path):
    recs = [(1, 1, "PUT", "a", "1"), (2, 2, "PUT", "b", "2"), (3, 1, "COMMIT", None, None), (4, 3, "PUT", "c", "3"), (5, 3, "ABORT", None, None), (6, 2, "PUT", "a", "later"), (7, 2, "COMMIT", None, None), (8, 4, "DELETE", "b", None), (9, 4, "COMMIT", None, None), (10, 5, "PUT", "open", "x")]
    make = lambda part: spark.createDataFrame(part, "seq long, txn long, type string, key string, value string")
    r = Replica(spark, f"file://{tmp_path}/r")
    for k, part in enumerate((recs[:2], recs[2:6], recs[6:])):
        r.apply(make(part), k)
        r.apply(make(part), k)
    want = {"a": "later"}
    assert {x["key"]: x["value"] for x in r.view().collect()} == want
    make(recs).repartition(2).write.parquet(f"{tmp_path}/log")
    q = Replica(spark, f"file://{tmp_path}/q")
    q.follow(read_records(spark, f"{tmp_path}/log"), f"{tmp_path}/cp").awaitTermination()
    assert {x["key"]: x["value"] for x in q.view().collect()} == want


def test_late_operations_and_reused_numbers(spark, tmp_path):
    make = lambda part: spark.createDataFrame(part, "seq long, txn long, type string, key string, value string")
    r = Replica(spark, f"file://{tmp_path}/r", compact_after=2)
    r.apply(make([(5, 1, "COMMIT", None, None), (9, 2, "COMMIT", None, None), (8, 2, "PUT", "a", "second"), (12, 3, "ABORT", None, None)]), 0)
    r.apply(make([(4, 1, "PUT", "a", "first"), (3, 1, "PUT", "b", "first"), (11, 3, "PUT", "b", "lost"), (20, 1, "PUT", "c", "again")]), 1)
    assert {x["key"]: x["value"] for x in r.view().collect()} == {"a": "second", "b": "first"}
    r.apply(make([(21, 1, "COMMIT", None, None), (7, 2, "DELETE", "b", None), (30, 1, "PUT", "c", "open")]), 2)
    r.apply(make([(8, 2, "PUT", "a", "second")]), 3)
    assert {x["key"]: x["value"] for x in r.view().collect()} == {"a": "second", "c": "again"}
    _, (state, waiting, ends, _), _ = r._tables()
    assert [x["seq"] for x in r.store.view(waiting).collect()] == [30] and r.store.view(ends).count() == 4 and len(state.batches) <= 2
    short = Replica(spark, f"file://{tmp_path}/s", lateness=10)
    short.apply(make([(5, 1, "COMMIT", None, None), (90, 2, "COMMIT", None, None)]), 0)
    short.apply(make([(4, 1, "PUT", "a", "too late"), (89, 2, "PUT", "b", "in time")]), 1)
    assert {x["key"]: x["value"] for x in short.view().collect()} == {"b": "in time"}


def test_many_operations_of_one_transaction(spark, tmp_path):
    many = 1_000_003
    (tmp_path / "in.json").write_text('{"txn": 1, "ops": [' + ",".join('["w","k","%d"]' % i for i in range(many)) + ']}\n{"txn": 2, "ops": [["w", "k", "last"], ["r", "k", null]]}\n')
    ops = oplog.read_ops(spark, f"{tmp_path}/in.json")
    last = ops.orderBy(F.desc("seq")).limit(3).collect()
    assert [(r["txn"], r["v"]) for r in last] == [(2, None), (2, "last"), (1, str(many - 1))] and ops.count() == many + 2


def test_json_transactions(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"txn": 1, "ops": [["r", "k", null], ["w", "k", "v"], ["r", "k", null]]}\n{"txn": 2, "ops": [["r", "k", null], ["x", "k", "1"]]}\n')
    seen = recovery.read_own_writes(oplog.read_ops(spark, f"{tmp_path}/in.json"))
    oplog.write_results(seen, f"{tmp_path}/out")
    got = {r["txn"]: r["ops"] for r in spark.read.schema(oplog.SCHEMA).json(f"{tmp_path}/out").collect()}
    assert got == {1: [["r", "k", None], ["w", "k", "v"], ["r", "k", "v"]], 2: [["r", "k", "v"]]}


def test_words(spark):
    assert lexer.split_statements("a ';' ; b (;) ;;") == ["a ';'", "b (;)"]
    assert lexer.table_names("SELECT t.name FROM tests t, users AS u WHERE t.id = u.id;") == ["tests", "users"]
    assert lexer.plan_tables(spark, "SELECT * FROM Tests t JOIN (SELECT 1 FROM users) u") == ["tests", "users"]
    assert lexer.table_names("CREATE INDEX email_idx ON users (email)") == ["users"]
    assert lexer.table_names("INSERT INTO `Log` VALUES (1)") == ["log"] and lexer.table_names("DROP TABLE IF EXISTS x") == ["x"]
    assert identifier(' "Ab" ') == "ab" and spark_type("varchar(3)").simpleString() == "string" and spark_type("float8").simpleString() == "double"


def test_formulas(spark):
    one = spark.range(1)
    levels = one.select(scalars.level_count(F.lit(400)), scalars.level_count(F.lit(70000)), scalars.level_capacity(F.lit(0), F.lit(3)), scalars.level_capacity(F.lit(2), F.lit(3))).first()
    assert tuple(levels) == (1, 3, 4, 4 * 40 * 20)
    bits = scalars.bloom_bits(F.lit(1500))
    assert tuple(one.select(bits, scalars.bloom_hashes(bits, F.lit(1500))).first()) == (14378, 7)
