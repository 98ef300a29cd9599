import hashlib
import math
import os
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftwell.llm import _tokens, ann_tree, chat_format, exact_dedup, mixing, packing, quality_qda, token_files, toxicity_gru
from driftwell.llm._stage import fresh_path, lean, staged

TEXTS = ["", " ", "  a", "a ", "a  b", "\n\na\n b \n", "x\t y", " a  ", "a\r\n b", "don't  'll 12 345", "a b　c  d", "İstanbul ÀÉ été DON'T. we'll, x.'s", "日本語。 テスト!", "a.b c..d ...e !?", "<|endoftext|> a", None, "word " * 3000]


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


# chat formatting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("</s>[INST]\\|_aé\nSY"))), st.text(alphabet=st.sampled_from(list("user\\\n<s>"))))
def test_turns_survive_formatting(text, role):
    seg, a, b, _ = chat_format.format_turn(role, [{"kind": "text", "text": text}])
    assert chat_format.parse_segment(seg) == (role, text)
    assert not chat_format.ESCAPE.search(seg[len(chat_format.TURN) : -len(chat_format.END) - 1]) or not any(c in chat_format.escape(text) for c in ("</s>", "[INST]", "<|end|>"))
    assert (chat_format.unescape(seg[a:b]) == text) if role == "assistant" else a == b


def test_parts_become_placeholders_in_order(spark):
    image = {"kind": "image", "ref": "i.png", "width": 28, "height": 15}
    parts = [{"kind": "text", "text": "see <|image|>"}, image, {"kind": "audio", "ref": "a", "seconds": 1.5}, {"kind": "document", "ref": "d", "pages": 3}, None, {"kind": "odd", "text": "!"}, {"kind": "image"}]
    seg, a, b, att = chat_format.format_turn("assistant", parts)
    assert seg[a:b] == "see <\\|image|><|image|><|audio|><|document|>!<|image|>"
    assert [(x["position"], x["kind"], x["ref"], x["tokens"]) for x in att] == [(0, "image", "i.png", 4), (1, "audio", "a", 38), (2, "document", "d", 1536), (3, "image", None, 1)]
    full = [{k: p.get(k) for k in ("kind", "text", "ref", "width", "height", "seconds", "pages")} for p in parts if p]
    df = spark.createDataFrame([(1, 0, "assistant", full), (1, 1, None, None), (None, None, "user", [])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    got = {r["turn"]: r for r in chat_format.format_turns(df).collect()}
    assert got[0]["segment"] == seg and got[0]["expanded_tokens"] == 4 + 38 + 1536 + 1 and got[1]["segment"] == "<|turn|>\n<|end|>\n"
    assert chat_format.split_segments(seg + got[1]["segment"]) == [seg, got[1]["segment"]]


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", "b</s>", 0), (1, 0, "user", None, 0), (2, 0, "assistant", "x", 0), (2, 0, "assistant", "x", 0), (None, 3, "user", "é" * 5, 0), (7, None, "user", "z" * 200_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_turns(chat_format.text_turns(df))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb</s>\n").hexdigest() and got[1]["loss_chars"] == 5
    assert got[2]["n_turns"] == 2 and got[2]["loss_sha256"] == hashlib.sha256(b"xx").hexdigest()
    assert got[None]["n_turns"] == 1 and got[7]["formatted_chars"] == 200_000 + len("<|turn|>user\n<|end|>\n")
    assert chat_format.read_back(chat_format.format_turns(chat_format.text_turns(df.limit(0)))).count() == 0


# exact dedup


def test_cuckoo_index_holds_what_a_dict_holds():
    rng, index, want = random.Random(2), exact_dedup.CuckooIndex(buckets=4, kicks=8), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(900)]
    for _ in range(6000):
        k = rng.choice(keys)
        if rng.random() < 0.3:
            index.delete(k)
            if k in want:
                want[k][1] -= 1
                if not want[k][1]:
                    del want[k]
        else:
            i = rng.randrange(1000)
            index.add(k, i, 1, 1)
            w = want.setdefault(k, [i, 0])
            w[0], w[1] = min(w[0], i), w[1] + 1
    assert index.live == len(want) and index.buckets > 4
    assert {k: (f, n) for k, (f, n, _) in index.items()} == {k: tuple(v) for k, v in want.items()}
    assert index.get(b"\0" * 32) is None


def test_colliding_fingerprints_are_told_apart():
    index = exact_dedup.CuckooIndex()
    a, b = b"\1" * 8 + b"a" * 24, b"\1" * 8 + b"b" * 24
    index.add(a, 1, 1, 0)
    assert index.get(b) is None
    index.add(b, 2, 1, 0)
    assert index.get(a)[0] == 1 and index.get(b)[0] == 2


def test_exact_classes(spark):
    rows = [(3, "a  b", 0), (1, "a\t\nb", 0), (2, "a b", 0), (4, None, 0), (5, "", 0), (6, " ", 0), (6, " ", 0), (None, "a b", 0), (None, "q", 0), (9, "a b", 0), (10, "long " * 50_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt int")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs).collect()), key=str)
    assert got == sorted([(3, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (None, 1, 4, False), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 2, True), (6, 6, 2, False), (None, None, 1, True), (9, 9, 1, True), (10, 10, 1, True)], key=str)
    kept = exact_dedup.drop_copies(docs)
    assert sorted((r["doc_id"] or -1 for r in kept.collect())) == [-1, 1, 4, 6, 9, 10] and kept.columns == docs.columns
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_scan_tasks_give_their_index_out(monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH", 5)
    frame = pd.DataFrame({"digest": [bytes([k % 7]) * 32 for k in range(70)], "first": range(70), "n": 1, "salts": [1] * 70})
    sizes = [index.live for index in exact_dedup._indices(iter([frame]), 5)]
    assert max(sizes) <= 5 and len(sizes) > 10
    got = next(exact_dedup._indices(exact_dedup._partial(iter([frame]))))
    assert sorted(r for _, r in got.items()) == [(k, 10, 1) for k in range(7)]


def test_kept_row_of_repeats_is_the_same_each_time(spark):
    rows = [(1, "a b", k) for k in range(50)] + [(None, "c", k) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long")
    got = [sorted(exact_dedup.drop_copies(docs.repartition(n)).collect(), key=str) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2


# tokens, packing and token files


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_ids_are_the_librarys(sf, name, spaced, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(_tokens, "KEPT", 500)
    monkeypatch.setattr(_tokens, "GROUP", 5_000)
    path = _tokens.vocabulary(name)
    plain, cached = Tokenizer.from_file(path), _tokens.CachedEncoder(path, spaced)
    odd = ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> b", "plain"]
    assert {i for t in odd for i in plain.encode(t, add_special_tokens=False).ids} & {50256, 49407}
    texts = TEXTS + odd + pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()[:60]
    for _ in range(2):
        ids, at = cached.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(cached.encode(pa.array([], pa.string()))[0]) == 0


def test_packing_loses_nothing_and_is_tight(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("row"))
    docs = docs.unionByName(spark.createDataFrame([(None, "x", 1), (3, None, 1), (3, "", 1), (4, "hello <|endoftext|> world", 1)], "doc_id long, text string, row int"))
    got = packing.pack_documents(docs, _tokens.vocabulary("byte_bpe_50k.json")).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(_tokens.vocabulary("byte_bpe_50k.json"))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == [sum(x["length"] for x in rows[:k]) for k in range(len(rows))] and sum(r["length"] for r in rows) <= 1024
    want = []
    for d, t in ((r["doc_id"], r["text"]) for r in docs.collect()):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [(0, min(first, len(ids)))] + [(s, 1024) for s in range(first, len(ids), 1024)]
        want += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts)]
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str)
    total = sum(r["length"] for r in got)
    big = sum(r["length"] > 512 for r in got)
    assert len(by) <= max(-(-total // 1024), big) * 1.02 + 2
    assert packing.pack_documents(docs.limit(0), _tokens.vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("lengths", [[600], [600, 500, 10], [1000, 24], [700, 200, 100, 30]])
def test_packing_tasks_stay_small(spark, monkeypatch, lengths):
    """However little fits together, no task gets all that is left."""
    monkeypatch.setattr(packing, "GROUP", 50)
    for n in (400, 4_000):
        seen = spark.sparkContext.accumulator(0)
        largest = []
        real = packing._pack

        def noted(capacity, level, real=real):
            def run(frames):
                def every():
                    for f in frames:
                        seen.add(len(f))
                        yield f

                yield from real(capacity, level)(every())

            return run

        monkeypatch.setattr(packing, "_pack", noted)
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").alias("row"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.element_at(F.array(*map(F.lit, lengths)), (F.col("id") % len(lengths)).cast("int") + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
        got = packing.pack(rows, n).collect()
        monkeypatch.setattr(packing, "_pack", real)
        groups = {}
        for r in got:
            groups.setdefault(r["sequence_id"] >> 24, []).append(r["length"])
        largest = max(map(len, groups.values()))
        assert len(got) == n and sum(r["length"] for r in got) == sum(lengths[i % len(lengths)] for i in range(n))
        assert largest <= 110 and seen.value <= 5 * n
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for s in sequences.values():
            assert [o for o, _ in sorted(s)] == [sum(x for _, x in sorted(s)[:k]) for k in range(len(s))] and sum(x for _, x in s) <= 1024


def test_sum_of_squares_places_like_its_rule():
    rng = np.random.default_rng(1)
    sizes = np.sort(rng.integers(1, 33, 300))[::-1]
    seq, offset = packing.sum_of_squares(sizes, 32)
    gaps: dict[int, int] = {}
    for s, q, o in zip(sizes.tolist(), seq.tolist(), offset.tolist(), strict=True):
        def after(g, s=s):
            count = {}
            for k, v in gaps.items():
                v = v - s if k == g else v
                if v:
                    count[v] = count.get(v, 0) + 1
            return sum(c * c for c in count.values())
        if q in gaps:
            assert o == 32 - gaps[q] and after(q) == min(after(k) for k, v in gaps.items() if v >= s)
        else:
            assert o == 0 and all(v < s for v in gaps.values())
            gaps[q] = 32
        gaps[q] -= s


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, sf, encoding):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id < 60").unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1001, "twice"), (1003, "long one " * 40_000), (1002, "<|startoftext|> a <|endoftext|>"), (None, "null id")], "doc_id long, text string"))
    path, out = _tokens.vocabulary("word_bpe_49k.json"), fresh_path(spark, "tokens-test")
    token_files.write_tokens(docs, out, path, encoding=encoding, row_group_bytes=64 << 10)
    plain, at, want = Tokenizer.from_file(path), 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.checksums(token_files.read_tokens(spark, out)).collect()), key=lambda r: r[1]) == want
    part = token_files.read_tokens(spark, out, 10, 20)
    assert [(r["doc_id"], r["start"], len(r["ids"])) for r in sorted(part.collect())] == [w[:3] for w in want if w[0] is not None and 10 <= w[0] <= 20]
    plan = token_files.read_metadata(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    files = [f for f in spark.read.parquet(out).inputFiles()]
    column = pq.ParquetFile(files[-1].removeprefix("file://")).metadata.row_group(0).column(4)
    assert column.path_in_schema == "ids.list.element" and (("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")) and column.has_column_index
    empty = fresh_path(spark, "tokens-none")
    token_files.write_tokens(docs.limit(0), empty, path)
    assert token_files.checksums(token_files.read_tokens(spark, empty)).count() == 0


# mixing


def water(sizes, share=1.5):
    """Targets by resharing the excess round after round."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    target, left, open_ = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        full = {i for i in open_ if left * w[i] / total >= 2 * sizes[i]}
        if not full:
            for i in open_:
                target[i] = left * w[i] / total
            break
        for i in full:
            target[i] = 2.0 * sizes[i]
        left -= sum(target[i] for i in full)
        open_ -= full
    return target


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 30)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 900])), rng.choice(["big"] * 6 + ["a", "é", "z", None, "tiny"]), "x") for i in range(400)]
    rows += [(7000, "w  w\nw", "one", "x"), (7000, "w  w\nw", "one", "x"), (7001, None, "empty", "x"), (None, "w", "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mixing.mixed_sizes(docs).collect()
    again = mixing.mixed_sizes(docs.repartition(3)).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((n for n in size if n is not None), key=lambda n: n.encode()) + [None]
    want = dict(zip(names, water([size[n] for n in names]), strict=True))
    source = {(r[0], len((r[1] or "").split())): r[2] for r in rows}
    taken = {}
    for r in got:
        n = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[n] and abs(r["target"] - want[n]) < 1e-6 * max(1, want[n]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[n] = taken.get(n, 0) + r["taken"]
    assert all(abs(taken[n] - want[n]) <= 0.5 for n in names)
    assert mixing.mixed_sizes(docs.limit(0)).count() == 0
    mixed = mixing.mixed_documents(docs).collect()
    words = {}
    for r in mixed:
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
        assert any(t is not None and t.startswith(r["text"]) for i, t, _, _ in rows if i == r["doc_id"])
    assert {n: w for n, w in words.items() if n != "one"} == {n: t for n, t in taken.items() if t and n != "one"}


def test_shards_are_exact_and_disjoint(spark):
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(120)]
    sized = mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    s, draws, runs = mixing.draw(sized, block_words=16, shard_words=200)
    assert "ends" not in draws.columns + s.columns
    pieces = mixing.mix(draws, runs, block_words=16).collect()
    quota = {r["src"]: r["quota"] for r in s.collect()}
    assert sum(p["n_words"] for p in pieces) == sum(quota.values())
    blocks = {}
    for p in pieces:
        blocks.setdefault(p["shard"], []).append(p["position"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in blocks.values()) and len(blocks) == 64
    own = {}
    for r in runs.collect():
        own.setdefault(r["src"], []).append((r["low"], r["high"], r["shard"]))
    for k, parts in own.items():
        parts.sort()
        assert [low for low, _, _ in parts] == [0, *(high for _, high, _ in parts[:-1])] and parts[-1][1] == -(-quota[k] // 16) and [x for *_, x in parts] == sorted(x for *_, x in parts)
    total = [sum(high - low for parts in own.values() for low, high, shard in parts if shard == k) for k in range(64)]
    assert max(total) - min(total) <= 1


def plain_tree(spark, quotas, shards, block_words, seed):
    """(src, shard) -> blocks, by exact inversion of the hypergeometric law; only the uniform numbers come from Spark."""
    nodes = {0: [-(-q // block_words) for q in quotas]}
    for level in range(shards.bit_length() - 1):
        u = {(r[0], r[1]): r[2] for r in spark.range(1 << level).selectExpr("id as node", f"explode(sequence(0, {len(quotas) - 1})) as i").selectExpr("node", "i", f"(shiftrightunsigned(xxhash64({seed}, {level}, node, i), 11) + 0.5D) / 9007199254740992D").collect()}
        below = {}
        for node, counts in nodes.items():
            pop, near = sum(counts), []
            draws = pop - pop // 2
            for i, c in enumerate(counts):
                ways = [math.comb(c, k) * math.comb(pop - c, draws - k) for k in range(min(c, draws) + 1)]
                want, k, total = u[node, i] * sum(ways), 0, ways[0]
                while total <= want:
                    k += 1
                    total += ways[k]
                near.append(k)
                pop, draws = pop - c, draws - k
            below[2 * node], below[2 * node + 1] = near, [c - x for c, x in zip(counts, near, strict=True)]
        nodes = below
    return {(i, shard): n for shard, counts in nodes.items() for i, n in enumerate(counts) if n}


def test_shards_hold_what_a_plain_tree_deals(spark):
    rows = [(i, f"w{i} " + "w " * (3 + 17 * i % 90), f"s{i * i % 4}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    s, draws, runs = mixing.draw(mixing.sized(docs), block_words=16, shard_words=400)
    quotas = [r["quota"] for r in s.orderBy("src").collect()]
    shards = 1 << max(3, math.ceil(math.log2(sum(quotas) / 400)))
    want = plain_tree(spark, quotas, shards, 16, mixing.SEED)
    assert {(r["src"], r["shard"]): r["high"] - r["low"] for r in runs.collect()} == want
    words, pieces = {}, mixing.mix(draws, runs, block_words=16)
    for p in pieces.collect():
        words[p["src"], p["shard"]] = words.get((p["src"], p["shard"]), 0) + p["n_words"]
    last = {i: max(x for j, x in want if j == i) for i in range(len(quotas))}
    for (i, shard), n in want.items():  # a source's last block may be short
        assert words[i, shard] == 16 * n - (-quotas[i] % 16 if shard == last[i] else 0)
    plan = mixing.mixed_sizes(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "stretch" in plan and "shard" in plan and "position" in plan


def test_jobs_lay_out_what_the_tree_deals(spark, tmp_path):
    rows = [(i, f"w{i} " + "w " * (7 * i % 600), f"s{i % 3}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pieces = mixing.mix(*mixing.draw(mixing.sized(docs))[1:]).collect()
    first, by_epoch = {}, {}
    for p in pieces:
        place = (p["shard"], p["position"])
        first[p["doc_id"]] = min(place, first.get(p["doc_id"], place))
        by_epoch[p["doc_id"], p["epoch"]] = min(place, by_epoch.get((p["doc_id"], p["epoch"]), place))
    sizes = mixing.mixed_sizes(docs)
    assert {r["doc_id"]: (r["shard"], r["position"]) for r in sizes.collect()} == {i: first.get(i, (None, None)) for i, _, _ in rows}
    mixing.mixed_documents(docs).write.parquet(f"{tmp_path}/mixed")
    files = sorted(f for f in os.listdir(f"{tmp_path}/mixed") if f.endswith(".parquet"))
    laid = [i for f in files for i in pq.read_table(f"{tmp_path}/mixed/{f}")["doc_id"].to_pylist()]
    assert len({s for s, _ in first.values()}) == 8 and laid == [i for _, i in sorted((place, i) for (i, _), place in by_epoch.items())]


def test_repeated_rows_are_mixed_each(spark):
    rows = [(1, "hot text of five", "a")] * 30 + [(None, "none known", "a")] * 4 + [(2, "b " * 40, "b"), (3, "c " * 90, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, words = {}, {}
    for r in mixing.mixed_sizes(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n} and words[1] > 4


def test_hypergeometric_draws(spark):
    rows = spark.range(20_000).select(F.expr("(id + 0.5D) / 20000").alias("u"), F.lit(30).cast("long").alias("g"), F.lit(70).cast("long").alias("r"), F.lit(20).cast("long").alias("n"))
    x = np.array([r[0] for r in rows.select(F.expr(mixing._hypergeometric("g", "r", "n", "u"))).collect()])
    plain = np.random.default_rng(0).hypergeometric(30, 70, 20, 200_000)
    assert abs(x.mean() - 6) < 0.01 and abs(x.var() - plain.var()) < 0.05 and x.min() >= 0 and x.max() <= 20


# classifiers


def test_quality(spark, sf):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_qda.quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.92 * len(got)  # from some 300 labels
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, "", "x"), (2, "word " * 100_000, "x")], "doc_id long, text string, score string")
    rows = quality_qda.quality_scores(odd, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality_qda.quality_scores(odd, none).collect()} == {0.5} and quality_qda.quality_scores(odd.limit(0), labels).count() == 0
    assert quality_qda.keep_good(odd, none).count() == 4
    one = quality_qda.quality_scores(odd, labels.filter("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_mahalanobis_differences_are_gaussian_densities():
    rng = np.random.default_rng(0)
    d = len(quality_qda.NAMES)
    x = rng.standard_normal((400, d)) @ np.diag(rng.random(d) + 0.5)
    y = (rng.random(400) < 0.4).astype(int)
    q = quality_qda._shrunk(x, y, 0.2, 0.1)
    z = (x - q.mid) / q.scale
    dens = []
    for m, f, part in zip(q.means, q.inverses, (0, 1), strict=True):
        c = np.linalg.inv(f) @ np.linalg.inv(f).T
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m) - 0.5 * np.linalg.slogdet(c)[1] + np.log(((y == part).sum() + 1) / 402))
    assert np.allclose(q.difference(x), dens[1] - dens[0])


def plain_statistics(text):
    """The document statistics, character by character and word by word."""
    b = (text or "").encode()
    kinds = dict.fromkeys(quality_qda._KINDS, 0)
    own = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "space": " \t\r\x0b\x0c", "newline": "\n", "stop": ".,;:'\"-", "shout": "!?", "bar": "|", "bracket": "()[]{}<>/\\"}
    kind = lambda c: "high" if c >= 128 else next((k for k, chars in own.items() if chr(c) in chars), "symbol")
    for c in b:
        kinds[kind(c)] += 1
    kinds["upper"] += sum((text or "").count(c) for c in "ÄÉÇÊÑÓÖÜ")
    out = [math.log((k + 1) / (len(b) - min(k, len(b)) + 1 + len(b) * 1e-3)) for k in kinds.values()]
    words, lines, logit = b.split(), b.split(b"\n"), lambda k, n: math.log((k + 0.5) / (n - min(k, n) + 0.5))
    sizes = [len(w) for w in words] or [0]
    mean = sum(sizes) / len(sizes)
    marked = sum(kind(w[-1]) in ("bar", "bracket", "symbol", "shout") for w in words)
    out += [math.log1p(len(b)), math.log1p(len(words)), math.log1p(mean), math.log1p((sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5), logit(len(set(words)), max(1, len(words))), logit(marked, max(1, len(words)))]
    pairs = len({(x, y) for x, y in zip(words, words[1:], strict=False)}) if len(words) > 1 else 1
    return out + [math.log1p(max(sizes)), math.log1p(len(lines)), logit(len(set(lines)), len(lines)), logit(pairs, max(1, len(words) - 1))]


def test_statistics_are_the_plain_ones(sf):
    texts = [t for t in TEXTS if t is None or "\u3000" not in t] + pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()[:80] + ["ÉTÉ! {x} |", "A\n\nA\nb?"]
    assert np.allclose(quality_qda.statistics(pa.array(texts, pa.string())), [plain_statistics(t) for t in texts])


def test_toxicity(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = toxicity_gru.toxicity_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.8  # from some 30 toxic texts; the check tables have two thousand
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (1, " \n ", "x"), (2, "word " * 50_000, "x")], "doc_id long, text string, score string")
    rows = toxicity_gru.toxicity_scores(odd, labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_gru.toxicity_scores(odd.limit(0), labels).count() == 0 and toxicity_gru.toxicity_scores(odd, labels.limit(0)).count() == 4


def plain_logit(net, text):
    """The largest window logit of one text, word by word and gate by gate."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = [w.strip(toxicity_gru.MARKS) for w in (text or "").lower().split() or [""]]
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    h, n, best = toxicity_gru.HIDDEN, len(words), -np.inf
    starts = [0] if n <= 24 else sorted({min(k * 12, n - 24) for k in range(-(-(n - 24) // 12) + 1)})
    lex = toxicity_gru.Lexicon(words)
    x = [np.concatenate([p["chars"][lex.grams[lex.at[i] : lex.at[i + 1]]].mean(0) if lex.count[i] else np.zeros(toxicity_gru.CHAR_DIM), p["word"][lex.bucket[i]]]) for i in range(n)]
    for a in starts:
        own = x[a : a + 24]
        states = np.zeros((len(own), 2 * h))
        for k, way in enumerate("fb"):
            s = np.zeros(h)
            for t in range(len(own)) if way == "f" else reversed(range(len(own))):
                g, r = own[t] @ p[f"wx{way}"] + p[f"bx{way}"], s @ p[f"wh{way}"]
                z, reset = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
                s = (1 - z) * np.tanh(g[2 * h :] + reset * r[2 * h :]) + z * s
                states[t, k * h : (k + 1) * h] = s
        e = [float(np.tanh(s @ p["wa"]) @ p["va"]) for s in states]
        weights = np.exp(e) / np.exp(e).sum() if e else np.zeros(0)
        best = max(best, float(sum((w * s for w, s in zip(weights, states, strict=True)), np.zeros(2 * h)) @ p["u"] + p["c"][0]))
    return best


def test_logits_are_the_plain_scorers():
    net, rng = toxicity_gru.BiGru(3), random.Random(4)
    texts = ["", None, "one", "One, two! (three)", " ".join(rng.choice(["alpha", "beta", "d'or", "x.", "ÉTÉ", "--", "y" * 30]) for _ in range(24)), *(" ".join(rng.choice(["alpha", "beta", "gamma!", "42"]) for _ in range(n)) for n in (25, 36, 37, 100))]
    assert np.allclose(toxicity_gru.logits(net, pa.array(texts, pa.string())), [plain_logit(net, t) for t in texts], atol=1e-4)


def test_gru_gradients():
    net = toxicity_gru.BiGru(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, at, lex = toxicity_gru.read_words(pa.array(["one two three two", "four", "five one", ""]))
    text, first, sizes = toxicity_gru.windows(at)
    words, y = toxicity_gru._pad(ids, first, sizes), np.array([1.0, 0.0, 1.0, 0.0])
    g, _ = net.gradients(lex, words, sizes, y)
    rng = np.random.default_rng(0)
    for k in ("wxf", "whb", "whf", "bxb", "wa", "va", "u", "c", "word", "chars"):
        flat = net.p[k].ravel()
        i = int(np.abs(g[k]).argmax()) if k in ("word", "chars") else int(rng.integers(flat.size))
        old, h = flat[i], 1e-3
        losses = []
        for s in (h, -h):
            flat[i] = old + s
            losses.append(net.gradients(lex, words, sizes, y)[1])
        flat[i] = old
        assert abs((losses[0] - losses[1]) / (2 * h) - g[k].ravel()[i]) < 2e-4, k


def test_windows_cover_every_word():
    at = np.array([0, 0, 5, 24 + 5, 29 + 100])
    text, first, size = toxicity_gru.windows(at)
    for t in range(4):
        seen = {w for k in np.flatnonzero(text == t) for w in range(first[k], first[k] + size[k])}
        assert seen == set(range(at[t], at[t + 1]))
    assert (text == 3).sum() == 8


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 8)).astype(np.float32)
    x[50:400] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] + [1.0] * 7), (5300, [None] + [1.0] * 7), (5400, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "q") for i, v in rows], "vec_id long, embedding array<float>, leaf string")
    got = ann_tree.search(df).collect()
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        d[q] = np.inf
        true = np.lexsort((np.arange(3000), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-9 for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hit, total = hit + len(set(true) & {r["vec_id"] for r in own}), total + 10
    assert {r["query_id"] for r in got} == set(range(0, 3000, 100)) and hit >= 0.9 * total
    few = ann_tree.search(df.filter("vec_id < 4")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (0, 3)]
    assert ann_tree.search(df.limit(0)).count() == 0


def test_repeated_vectors_are_searched_once(spark, monkeypatch):
    """Against brute force over rows: repeated queries, repeated candidates, one id with two vectors, small blocks and chunks."""
    monkeypatch.setattr(ann_tree, "BLOCK", 16)
    monkeypatch.setattr(ann_tree, "CHUNK", 3)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(4).round(3).tolist()) for i in range(50)]
    rows += [rows[0], rows[0], rows[7], rows[7], (20, rng.standard_normal(4).round(3).tolist()), (31, rows[10][1])]
    got = ann_tree.search(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, query long, block int"), every=10).collect()
    want = []
    for q, x in sorted({(i, tuple(v)) for i, v in rows if i % 10 == 0}):
        near = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q)[:10]
        want += [(q, k + 1, i, round(d, 9)) for k, (d, i) in enumerate(near)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(want)


def test_staged_tables_keep_schema(spark):
    df = spark.createDataFrame([(1, None)], "a int, b array<struct<x:long>>")
    assert staged(df, "t").schema == df.schema


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_slices_give_the_ids_of_whole_texts(monkeypatch, name, spaced):
    from tokenizers import Tokenizer

    texts = ["a b", None, "", "long " * 50, "x <|endoftext|> y", "a b", None]
    monkeypatch.setattr(_tokens, "GROUP", 12)
    path = _tokens.vocabulary(name)
    code, plain = _tokens.CachedEncoder(path, spaced), Tokenizer.from_file(path)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": pa.array(texts, pa.string())})
    got = [(d, ids[i:j].tolist()) for b, ids, at in code.slices(batch) for d, i, j in zip(b.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True)]
    assert got == [(d, plain.encode(t or "", add_special_tokens=False).ids) for d, t in enumerate(texts)]
    assert len(list(code.slices(batch))) > 2 and not list(code.slices(batch.slice(0, 0)))


def test_lean_tasks_give_what_they_gave(spark):
    def twice(batches):
        for b in batches:
            yield b
            yield b

    assert list(lean(twice)(iter([1, 2, None]))) == [1, 1, 2, 2, None, None]
    assert list(lean(twice)(iter([]))) == []
    rows = spark.range(1000).repartition(3)
    assert rows.mapInPandas(lean(twice), "id long").groupBy().sum("id").first()[0] == 999_000
