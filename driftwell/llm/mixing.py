"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents stand in a random order (a hash of seed, epoch and doc_id); its words
in that order are cut into blocks, and the mix takes the first blocks up to the source's
target, going through the source again (in another order) where the target is larger than
the source. How many blocks of each source an output shard gets comes from a binary tree
over the shards: a node's counts are split between its halves by a multivariate
hypergeometric draw, so every shard has its exact size and every source its exact quota.
Shards take disjoint runs of the permuted blocks and shuffle them by another hash.

All of it is DataFrame and SQL expressions. Random numbers are hashes, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import release, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS, SHARD_WORDS, SEED = 256, 32_000_000, 17
#: Blocks that meet their shards' runs under one join key.
STRETCH = 256
#: Documents of one window; sources of a broadcast table.
BUCKET_ROWS, BROADCAST_SOURCES = 20_000, 50_000


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """doc_id, a hash of the text, source and size of every row, with a row number ``rid`` (the column of that name, or a new one); written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), (F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"))
    return staged(rows, "sized")


def targets(rows: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """A row for each source: number ``src`` by code point (null last), source_size, target, quota.

    A source is full when its limit (``repeats`` times its size) is at most what its weight
    would give it of what the fuller ones leave; in order of limit over weight the full
    sources come first, so one pass replaces resharing round after round.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("src", (F.row_number().over(one) - 1).cast("int"))
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("src") % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    before = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("cap") / F.col("w"), "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("level", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    s = s.withColumn("target", target).withColumn("quota", F.round("target").cast("long"))
    return s.select("source", "src", "source_size", "target", "quota")


def _hypergeometric(good: str, rest: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric draw by inversion: ``draws`` balls of ``good`` + ``rest``, how many good ones, for a uniform ``u``.

    Weights follow from each other by the ratio of neighbouring probabilities, over the
    values within 8.5 standard deviations and 9 more of the mean.
    """
    n = f"cast(greatest({good} + {rest}, 1) as double)"
    mean = f"({draws} * {good} / {n})"
    sd = f"sqrt({draws} * ({good} / {n}) * ({rest} / {n}) * greatest({n} - {draws}, 0D) / greatest({n} - 1, 1D))"
    low = f"cast(greatest(0, {draws} - {rest}, floor({mean} - 8.5 * {sd}) - 9) as bigint)"
    high = f"cast(least({good}, {draws}, ceil({mean} + 8.5 * {sd}) + 9) as bigint)"
    ratio = f"(({good} - k) * cast({draws} - k as double)) / ((k + 1) * cast({rest} - {draws} + k + 1 as double))"
    total = f"aggregate(sequence(b.lo, b.hi), struct(1D as w, 0D as t), (a, k) -> struct(a.w * {ratio} as w, a.t + a.w as t), a -> a.t)"
    find = f"aggregate(sequence(b.lo, b.hi), struct(1D as w, 0D as t, b.lo as x), (a, k) -> struct(a.w * {ratio} as w, a.t + a.w as t, if(a.t < {u} * total, k, a.x) as x), a -> a.x)"
    return f"transform(array(struct({low} as lo, {high} as hi)), b -> transform(array({total}), total -> {find})[0])[0]"


def shard_runs(sources: DataFrame, shards: int, block_words: int, seed: int) -> DataFrame:
    """(src, quota) -> src, shard, low, high: the run of a source's blocks (``high`` excluded) that a shard takes, where it takes any."""
    blocks = F.ceil(F.col("quota") / F.lit(block_words)).cast("long")
    counts = F.transform(F.sort_array(F.collect_list(F.struct("src", blocks.alias("n")))), lambda x: x["n"])
    nodes = sources.agg(counts.alias("counts")).select(F.lit(0).cast("long").alias("node"), "counts")
    u = f"((shiftrightunsigned(xxhash64({seed}, level, node, i), 11) + 0.5D) / 9007199254740992D)"
    x = _hypergeometric("e.c", "(s.pop - e.c)", "s.draws", "e.u")
    for level in range(int(math.log2(shards))):
        pairs = f"transform(counts, (c, i) -> struct(c as c, {u.replace('level', str(level))} as u))"
        step = f"transform(array({x}), x -> struct(s.pop - e.c as pop, s.draws - x as draws, concat(s.taken, array(x)) as taken))[0]"
        drawn = f"aggregate({pairs}, struct(total as pop, total - total div 2 as draws, cast(array() as array<bigint>) as taken), (s, e) -> {step}, s -> s.taken)"
        nodes = nodes.withColumn("total", F.expr("aggregate(counts, 0L, (a, c) -> a + c)")).withColumn("near", F.expr(drawn))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("near").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(counts, near, (c, x) -> c - x)").alias("counts")))
        nodes = nodes.select(F.explode(halves).alias("h")).select("h.node", "h.counts")
    runs = nodes.select(F.col("node").cast("int").alias("shard"), F.posexplode("counts").alias("src", "n")).filter("n > 0")
    high = F.sum("n").over(Window.partitionBy("src").orderBy("shard"))
    return runs.select("src", "shard", (high - F.col("n")).alias("low"), high.alias("high"))


def draw(rows: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, draws, runs) of ``sized`` rows.

    Draws have a row for each document and epoch of which the mix takes words: rid, doc_id,
    text_key, epoch, ``at`` (the document's place among the words drawn from its source),
    taken, src. The words taken are the document's first. Runs are ``shard_runs``.
    """
    s = staged(targets(rows, share, repeats, weights), "targets")
    facts = s.agg(F.sum("quota"), F.count("*")).first()
    shards = 2 ** max(3, math.ceil(math.log2(max(1, (facts[0] or 0) / shard_words))))
    runs = staged(shard_runs(s, shards, block_words, seed), "runs")
    known = F.broadcast(s) if facts[1] <= BROADCAST_SOURCES else s
    n_rows = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, n_rows / BUCKET_ROWS))))
    d = rows.join(known.drop("target"), rows["source"].eqNullSafe(known["source"])).drop("source")
    epochs = F.ceil(F.col("quota") / F.col("source_size")).cast("int")
    d = d.filter("size > 0 and quota > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    d = d.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id", "text_key"))
    d = d.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long"))
    keys = ["src", "epoch", "bucket"]
    sums = d.groupBy(*keys).agg(F.sum("size").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("src", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sums.select(*keys, base.alias("base")), keys)
    inner = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("h", "doc_id", "text_key", "rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("base") + inner)
    d = d.withColumn("taken", F.least(F.col("size"), F.col("quota") - F.col("at"))).filter("taken > 0")
    return s, d.select("rid", "doc_id", "text_key", "epoch", "at", "taken", "src"), runs


def mix(draws: DataFrame, runs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Draws -> a row for each block's part of a document: shard, position there, src, rid, doc_id, epoch, first_word, n_words.

    A block finds its shard among the runs that reach into its stretch of ``STRETCH`` blocks, so
    a join key has that many blocks and runs at most, however long the source.
    """
    b = F.col("block") * block_words
    p = draws.withColumn("block", F.explode(F.expr(f"sequence(at div {block_words}, (at + taken - 1) div {block_words})")))
    p = p.withColumn("first_word", F.greatest(b, F.col("at")) - F.col("at"))
    p = p.withColumn("n_words", F.least(b + block_words, F.col("at") + F.col("taken")) - F.greatest(b, F.col("at")))
    p = p.withColumn("stretch", F.expr(f"block div {STRETCH}"))
    reach = runs.withColumn("stretch", F.explode(F.expr(f"sequence(low div {STRETCH}, (high - 1) div {STRETCH})")))
    p = p.join(reach, ["src", "stretch"]).filter("block >= low and block < high")
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "src", "block"), "src", "block", "at")
    p = p.withColumn("position", F.row_number().over(place))
    return p.select("shard", "position", "src", "rid", "doc_id", "epoch", "first_word", "n_words")


def placed(pieces: DataFrame, *by: str) -> DataFrame:
    """``mix``'s pieces -> a row for each ``by``: its words taken, and shard and position of its first piece there."""
    # one number, as structs don't go into hash aggregates
    place = F.shiftleft(F.col("shard").cast("long"), 40) + F.col("position")
    out = pieces.groupBy(*by).agg(F.sum("n_words").alias("taken"), F.min(place).alias("place"))
    return out.select(*by, "taken", F.shiftright("place", 40).cast("int").alias("shard"), F.col("place").bitwiseAND((1 << 40) - 1).alias("position"))


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, shard, position.

    Shard and position are the place of the first of its pieces in the mix; null if none is taken.
    Null texts have size 0 and are never taken; a null source is a source of its own, the
    last; rows that repeat a doc_id are documents of their own (those that repeat the text too
    stand next to each other in the random order). An empty table gives an
    empty result. Other columns are not read.
    """
    rows = sized(docs)
    s, draws, runs = draw(rows)
    taken = placed(mix(draws, runs), "rid")
    known = F.broadcast(s) if s.count() <= BROADCAST_SOURCES else s
    out = rows.join(known, rows["source"].eqNullSafe(known["source"])).join(taken, "rid", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shard", "position")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each document and epoch, with the columns of ``docs``.

    At most one document of each source is taken in part; its text ends after the last
    word taken, and n_chars follows. Rows that repeat both doc_id and text are documents of their own.
    Rows lie by shard and shuffled place; a document goes whole to where its first piece is.
    """
    numbered = staged(docs.withColumn("_dw_row", F.monotonically_increasing_id()), "numbered")
    rows = sized(numbered, "_dw_row")
    _, draws, runs = draw(rows)
    places = placed(mix(draws, runs), "rid", "epoch").join(rows.select("rid", "size"), "rid")
    draws = staged(places.select(F.col("rid").alias("_dw_row"), F.col("taken").alias("_dw_taken"), F.col("size").alias("_dw_size"), F.col("shard").alias("_dw_shard"), F.col("position").alias("_dw_position")), "draws")
    release(rows)
    d = numbered.join(draws, "_dw_row")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("_dw_taken").cast("int")), "")
    cut = F.col("_dw_taken") < F.col("_dw_size")
    columns = {"text": F.when(cut, part).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(part)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    place = ["_dw_shard", "_dw_position"]
    return d.withColumns(columns).repartitionByRange(*place).sortWithinPartitions(*place).select(*docs.columns)


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return mixed_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
