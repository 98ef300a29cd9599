import hashlib
import random

from driftwell.llm import warc as w
from driftwell.llm._stage import fresh_path


def test_loser_tree_merges_like_sorted():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(w.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_round_trip_with_revisits_nulls_and_repeats(spark):
    big, odd = "<p>" + "ä" * 200, "a\r\n\r\nb" * 40
    rows = [(5, "http://b.example.com/x", big, "z"), (3, "http://a.example.com/y", big, "z"), (9, None, None, "z"), (8, "", "", "z"), (7, "http://[bad", "short", "z"), (6, "u v", "short", "z"), (2, "http://a.example.com/y", odd, "z"), (None, "http://a.example.com/", odd, "z"), (4, "http://a.example.com/y", big, "z"), (3, "http://a.example.com/y", big, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    folder = fresh_path(spark, "warc-test")
    got = w.archive(pages, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        of = [h or "" for i, _, h, _ in rows if i == r["page_id"]][0].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(of), hashlib.sha256(of).hexdigest())
    assert sorted((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit" and r["page_id"]) == [(4, 3), (5, 3)]
    assert [r["refers_to"] for r in got if r["page_id"] is None] == [2]
    assert w.archive(pages.limit(0), fresh_path(spark, "warc-none")).count() == 0


def test_merged_index_is_globally_ordered(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.example.com/{rng.randrange(9)}", f"page {i}") for i in range(300)]
    folder = fresh_path(spark, "warc-order")
    runs = w.staged(w.write_archives(w.decide(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)), folder, archive_bytes=3000), "captures")
    assert runs.select("run").distinct().count() > 1 and runs.select("file").distinct().count() > 5
    m = [(r["urlkey"], r["ts"], r["page_id"]) for r in sorted(w.merge_runs(runs).collect(), key=lambda r: (r["part"], r["place"]))]
    assert m == sorted(m) and len(m) == 300
    h = {r["urlkey"]: r["captures"] for r in w.histories(w.merge_runs(runs)).collect()}
    assert sum(h.values()) == 300 and set(h) == {k for k, _, _ in m}


def test_ranges_stay_small_whatever_the_url(spark, monkeypatch):
    """All captures of one URL and one time: ranges still split, and no task gets more than its share of what a third more may add."""
    monkeypatch.setattr(w, "RANGE", 100)
    for n in (300, 3_000):
        runs = w.staged(spark.range(n).selectExpr("concat('r', id % 4) as run", "id div 4 as nth", "'com,x)/' as urlkey", "'20240101000000' as ts", "7L as page_id", "'response' as record_type", "'d' as digest", "'f' as file", "id as offset", "1L as length"), "runs")
        got = w.merge_runs(runs).collect()
        parts = {}
        for r in got:
            parts.setdefault(r["part"], []).append(r["place"])
        assert len(got) == n and max(map(len, parts.values())) <= 200 and all(sorted(p) == list(range(len(p))) for p in parts.values())


def test_large_payloads(spark):
    big = "<p>" + "x" * 20_000_000
    got = w.archive(spark.createDataFrame([(1, "http://a.example.com/", big), (2, "http://a.example.com/", big), (3, None, "y" * 99)], "page_id long, url string, html string"), fresh_path(spark, "warc-big")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [(1, len(big), "response", None), (2, len(big), "revisit", 1), (3, 99, "response", None)]


def test_url_keys():
    assert w.url_key("http://www.x.com") == "com,x)/" and w.url_key("https://x.com:8443/A?Q=1") == "com,x:8443)/a?q=1" and w.url_key(None) == "-"
