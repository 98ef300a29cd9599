"""Near-duplicate detection with BagMinHash signatures of word shingles.

A document is a multiset of shingles of five words (fewer words: one shingle of them all;
words end at ASCII white space). Two documents are near duplicates from a multiset
Jaccard similarity (sum of minima over sum of maxima) of 0.8. A class is a connected
component of near duplicates; its id is the smallest doc_id in it.

Equal word sequences are put together first, so copies cost one signature's work. The
others meet in the buckets of ``BANDS`` bands; nothing lists the pairs of a bucket:

1. each document is compared with the leader (the smallest id) of each of its buckets, 36
   comparisons at most;
2. the members of buckets that still hold several components are joined exactly. By the
   prefix filter, similar documents share one of the rarest fifth of their shingles, so only
   documents that such shingles connect can be similar; each set of these (a family) is cut into
   blocks of ``BLOCK`` shingles (smaller ones, of ``LITTLE``, up to ``SPREAD`` of them, so that a
   family of middling size is more than one task's work), and a task counts what the documents
   of two blocks share.
   It gives back the links that join components, at most one for each document.

Every link comes from comparing the whole multisets. A pair at 0.8 shares no band with
probability (1 - 0.8^7)^36 = 0.0002, at 0.85 less than 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exact_dedup
from ._stage import lean, release, staged

WORDS, BANDS, ROWS = 5, 36, 7
BLOCK, LITTLE, SPREAD = 1_500_000, 60_000, 8
POINTS = 30_000  # of all processes that a step of the signatures takes, where few are left
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64, in place."""
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hashes of all shingles, sorted within each text; where each text's begin (one more at the end); digests of the word sequences."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    lengths = np.diff(at)
    empty = pc.equal(pc.binary_length(texts if texts.null_count == 0 else pc.fill_null(texts, "")), 0).to_numpy(zero_copy_only=False)
    if len(flat):
        coded = flat.dictionary_encode()
        words = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[coded.indices.to_numpy()]
        one = np.flatnonzero((lengths == 1) & ~empty)  # a text of white space alone splits into one empty word
        blank = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        empty = empty.copy()
        empty[one] |= blank[at[:-1][one]]
    else:
        words = np.empty(0, np.uint64)
    n = np.where(empty, 0, lengths)
    rolled = words.copy()
    for k in range(1, min(WORDS, len(words))):
        rolled[:-k] = _mix(rolled[:-k] * _A + words[k:])
    counts = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out, digests = np.empty(starts[-1], np.uint64), []
    for i, (a, m, s, e) in enumerate(zip(at[:-1].tolist(), n.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        digests.append(hashlib.sha256(words[a : a + m].tobytes()).digest())
        if m >= WORDS:
            out[s:e] = np.sort(rolled[a : a + e - s])
        elif m:
            out[s] = np.frombuffer(digests[i][:8], np.uint64)[0]
    return out, starts, digests


def _counted(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle), with how often it occurs: text, shingle, count."""
    if not len(values):
        return np.empty(0, np.int64), values, np.empty(0, np.int64)
    new = np.empty(len(values), bool)
    new[0], new[1:] = True, values[1:] != values[:-1]
    new[starts[:-1][starts[:-1] < len(values)]] = True
    first = np.flatnonzero(new)
    text = np.searchsorted(starts, first, side="right") - 1
    return text, values[first], np.diff(np.append(first, len(values)))


def bag_minhash(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures (texts x m) of multisets given as (text, shingle, count) rows; the share of equal registers estimates the similarity.

    Weights are cut into the levels [0, 1), [1, 2), [2, 4), [4, 8) ... Each shingle and level
    has a Poisson process of its own, with the level's width as rate; a point has a time, a
    register and a place in the level. The levels are the hierarchy: a level's process is not
    split further, as a level that reaches beyond the weight is thinned instead (its points
    count where their place lies below). A register holds the earliest time. All
    processes advance by a point at a time (by more where few are left), and one stops once
    it is later than every register of its text. Times are multiples of 2^-30, so their sums
    are exact and equal points give equal registers on any machine.
    """
    sig = np.full(texts * m, np.inf)
    doc, seed, rate, low, limit = [text], [shingle ^ _A], [np.ones(len(text))], [np.zeros(len(text), np.int64)], [count]
    level = 1
    while len(own := np.flatnonzero(count > level)):
        doc.append(text[own])
        seed.append(_mix(shingle[own] + np.array(level, np.uint64)[None] * _C))
        rate.append(np.full(len(own), float(level)))
        low.append(np.full(len(own), level, np.int64))
        limit.append(count[own])
        level *= 2
    doc, seed, rate, low, limit = (np.concatenate(x) for x in (doc, seed, rate, low, limit))
    time, step = np.zeros(len(doc)), 1
    while len(doc):
        ahead = int(np.clip(POINTS // len(doc), 1, 64))  # points beyond the last register's time do no harm
        h = _mix(seed[:, None] + np.arange(step, step + ahead, dtype=np.uint64) * _A)
        gap = np.rint(np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * -(2.0**30)) * 2.0**-30
        gap /= rate[:, None]
        gap[:, 0] += time
        at = np.cumsum(gap, axis=1)
        h = _mix(h + _C)
        register = (((h >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        if low.any():
            place = low[:, None] + (h & np.uint64(0xFFFFFFFF)).astype(np.int64) % np.maximum(low, 1)[:, None]
            hit = place < limit[:, None]
            np.minimum.at(sig, (doc[:, None] * m + register)[hit], at[hit])
        else:
            np.minimum.at(sig, (doc[:, None] * m + register).ravel(), at.ravel())
        open_, number = np.unique(doc, return_inverse=True)
        on = at[:, -1] < sig.reshape(texts, m)[open_].max(1)[number]
        doc, seed, rate, low, limit, time, step = doc[on], seed[on], rate[on], low[on], limit[on], at[on, -1], step + ahead
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of each signature; the band's number is part of it."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _C, (len(sig), 1))
    for r in range(ROWS):
        key = _mix(key * _A + bits[:, :, r])
    return key.view(np.int64)


def _parts(b: pa.RecordBatch, chars: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars, side="right")))
        yield b.slice(at, end - at)
        at = end


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest of its words, band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                values, starts, digests = shingles(b.column("text"))
                text, shingle, count = _counted(values, starts)
                some = np.diff(starts) > 0
                at = np.cumsum(some) - 1
                n = int(some.sum())
                keys = band_keys(bag_minhash(at[text], shingle, count, n, BANDS * ROWS)) if n else np.empty((0, BANDS), np.int64)
                offsets = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["doc_id", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, digest binary, bands array<long>")


def _tokens(values: np.ndarray) -> np.ndarray:
    """The k-th occurrence of a shingle as a token of its own: a multiset as a sorted set."""
    if len(values) < 2:
        return values
    pos = np.arange(len(values))
    new = np.empty(len(values), bool)
    new[0], new[1:] = True, values[1:] != values[:-1]
    nth = pos - np.maximum.accumulate(np.where(new, pos, 0))
    return np.sort(np.where(nth > 0, _mix(values + nth.astype(np.uint64) * _C), values))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted token sets have a Jaccard similarity of 0.8 or more."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 5 * both >= 4 * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, lead) pairs that are near duplicates. ``texts``: doc, text.

    A leader's text goes ahead of the texts compared with it; a leader with many pairs is
    spread over 32 keys. A task holds one leader's tokens and one batch.
    """
    salt = F.pmod(F.xxhash64("doc"), F.lit(32))
    asked = pairs.select("lead", "doc", salt.alias("salt"))
    leads = asked.select("lead", "salt").distinct().select("lead", F.col("lead").alias("doc"), "salt")
    rows = asked.withColumn("first", F.lit(False)).unionByName(leads.withColumn("first", F.lit(True)))
    rows = rows.join(texts, "doc").repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.desc("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"of": None, "tokens": None}
        for whole in batches:
            for b in _parts(whole):
                values, starts, _ = shingles(b.column("text"))
                out: list[tuple[int, int]] = []
                for i, (lead, doc, first) in enumerate(zip(b.column("lead").to_pylist(), b.column("doc").to_pylist(), b.column("first").to_pylist(), strict=True)):
                    t = _tokens(values[starts[i] : starts[i + 1]])
                    if first:
                        held = {"of": lead, "tokens": t}
                    elif held["of"] == lead and similar(held["tokens"], t):
                        out.append((doc, lead))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["doc", "lead"])

    return rows.select("lead", "doc", "first", "text").mapInArrow(lean(run), "doc long, lead long")


def components(edges: DataFrame) -> DataFrame:
    """(doc, lead) links -> doc, comp (the smallest id that links reach) for every linked document.

    Labels pass along links and jump to their label's label until nothing changes; each
    round is a written table.
    """
    both = staged(edges.union(edges.select("lead", "doc")).toDF("doc", "other").distinct(), "links")
    label = staged(both.groupBy("doc").agg(F.least("doc", F.min("other")).alias("comp")), "labels")
    while True:
        seen = both.join(label.select(F.col("doc").alias("other"), F.col("comp").alias("near")), "other").groupBy("doc").agg(F.min("near").alias("near"))
        step = label.join(seen, "doc").select("doc", F.least("comp", "near").alias("new"), "comp")
        jump = step.join(label.select(F.col("doc").alias("new"), F.col("comp").alias("root")), "new", "left")
        done = staged(jump.select("doc", F.least("new", F.coalesce("root", "new")).alias("comp"), F.col("comp").alias("was")), "labels")
        same = done.filter("comp <> was").isEmpty()
        release(label)
        label = done
        if same:
            release(both)
            return label.select("doc", "comp")


def _with_comp(rows: DataFrame, label: DataFrame | None, doc: str, comp: str) -> DataFrame:
    if label is None:
        return rows.withColumn(comp, F.col(doc))
    return rows.join(label.select(F.col("doc").alias(doc), F.col("comp").alias("_c")), doc, "left").withColumn(comp, F.coalesce("_c", doc)).drop("_c")


def _token_sets(open_docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, comp) -> the same with the document's tokens, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _parts(whole):
                values, starts, _ = shingles(b.column("text"))
                sets = [_tokens(values[s:e]).view(np.int64) for s, e in zip(starts[:-1], starts[1:], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("comp"), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["doc", "comp", "tokens"])

    rows = open_docs.join(texts, "doc").select("doc", "comp", "text").mapInArrow(lean(run), "doc long, comp long, tokens array<long>")
    return staged(rows, "tokens")


def _families(sets: DataFrame) -> DataFrame | None:
    """(doc, family) of documents that one of the rarest fifth of their tokens ties to another component; the links are stars, a token's smallest document in the middle."""
    rows = sets.select("doc", "comp", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    many = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    nth = F.row_number().over(Window.partitionBy("doc").orderBy(F.coalesce("df", F.lit(1)), "token"))
    first = rows.join(many, "token", "left").withColumn("nth", nth).filter(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * F.lit(4) / F.lit(5)) + 1)
    first = staged(first.filter("df > 1").select("token", "doc", "comp"), "prefixes")
    heads = first.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("doc").alias("lead")).filter("lo <> hi").select("token", "lead")
    stars = staged(first.join(heads, "token").filter("doc <> lead").select("doc", "lead").distinct(), "stars")
    return None if stars.isEmpty() else components(stars).withColumnRenamed("comp", "family")


def _family_links(sets: DataFrame, families: DataFrame) -> DataFrame:
    """(doc, lead) links that join components of a family."""
    own = staged(sets.join(families, "doc"), "family")
    total = F.sum(F.size("tokens"))
    number = F.greatest(F.ceil(total / F.lit(BLOCK)), F.least(F.ceil(total / F.lit(LITTLE)), F.lit(SPREAD)))
    blocks = own.groupBy("family").agg(number.cast("int").alias("blocks"))
    own = own.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = own.withColumn("pair", F.explode(pair)).select("family", "pair.i", "pair.j", "block", "doc", "comp", "tokens")
    dealt = dealt.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "comp", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in batches:
            sets = b.column("tokens")
            values, at = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            for r, key in enumerate(zip(b.column("family").to_pylist(), b.column("i").to_pylist(), b.column("j").to_pylist(), strict=True)):
                if key != here:
                    if held:
                        yield _joined(held)
                    here, held = key, []
                held.append((b.column("block")[r].as_py() == key[1], key[1] == key[2], b.column("doc")[r].as_py(), b.column("comp")[r].as_py(), values[at[r] : at[r + 1]].copy()))
        if held:
            yield _joined(held)

    return dealt.mapInArrow(lean(run), "doc long, lead long")


def _joined(held: list[tuple]) -> pa.RecordBatch:
    """Links between two blocks (or within one) that join components which earlier links have not joined."""
    left = held if held[0][1] else [h for h in held if h[0]]
    right = held if held[0][1] else [h for h in held if not h[0]]
    root, out = {}, []

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    if left and right:
        sizes = np.array([len(h[4]) for h in right])
        tokens = np.concatenate([h[4] for h in right])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(right)), sizes)[order]
        for _, _, doc, comp, own in left:
            a, z = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            n = z - a
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            both = np.bincount(owner[at], minlength=len(right))
            for k in np.flatnonzero(5 * both >= 4 * (len(own) + sizes - both)).tolist():
                if (p := find(comp)) != (q := find(right[k][3])):
                    root[max(p, q)] = min(p, q)
                    out.append((doc, right[k][2]))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["doc", "lead"])


def link(texts: DataFrame, bands: DataFrame) -> DataFrame | None:
    """Links between documents with different words -> their components; None without any. ``texts``: doc, text; ``bands``: doc, bands."""
    rows = bands.select("doc", F.explode("bands").alias("bucket"))
    lead = rows.groupBy("bucket").agg(F.min("doc").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n")
    buckets = staged(rows.join(lead, "bucket"), "buckets")
    if buckets.isEmpty():
        return None
    texts = staged(texts.join(buckets.select("doc").distinct(), "doc", "left_semi"), "texts")
    pairs = buckets.filter("doc <> lead").select("doc", "lead").distinct()
    edges = staged(verified(pairs, texts), "edges")
    label = None if edges.isEmpty() else staged(components(edges), "comps")
    with_comp = _with_comp(buckets, label, "doc", "comp")
    mixed = with_comp.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo <> hi and n > 2")
    open_docs = staged(with_comp.join(mixed.select("bucket"), "bucket", "left_semi").select("doc", "comp").distinct(), "open")
    if not open_docs.isEmpty():
        sets = _token_sets(open_docs, texts)
        families = _families(sets)
        if families is not None:
            new = staged(_family_links(sets, families), "edges")
            if not new.isEmpty():
                label = staged(components(edges.union(new)), "comps")
        release(sets)
    release(buckets, texts, open_docs)
    return label


def near_classes(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, class_id, class_size, kept.

    A null text counts as empty; documents without words are one class. A null doc_id
    belongs to the class of equal words and has no near duplicates of its own; it has a
    null class if all ids there are null. The document whose id is the class's stays; of
    rows that repeat that id in the class, one. Rows that share an id but not their words
    are classed by their own words. An empty table gives an empty result; other columns are not read.
    """
    return _classified(docs).select("doc_id", "class_id", "class_size", "kept")


def word_digest(text: Column) -> Column:
    """``sketch``'s digest of the word sequence."""

    def run(texts: pd.Series) -> pd.Series:
        b = pa.record_batch([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        return pd.Series([d for part in _parts(b) for d in shingles(part.column("text"))[2]], dtype=object)

    return F.pandas_udf(run, "binary")(text)


def _classified(docs: DataFrame) -> DataFrame:
    """``near_classes`` with the digest of each row's words."""
    s = sketch(docs).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(exact_dedup.SALTS)).cast("int"))
    s = staged(s, "sketches")
    nth = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id").orderBy(F.lit(1)))
    own = staged(s.join(exact_dedup.classes(s.select("doc_id", "digest", "salt")), ["digest", "salt"]).select("doc_id", "digest", F.col("keep_id").alias("doc"), (nth == 1).alias("once"), "bands"), "copies")
    release(s)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").dropna(subset=["doc"])
    if not own.select("doc_id", "digest").distinct().groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _classified_apart(own, texts)
    one = own.filter("doc_id = doc and once")
    label = link(_single(texts), one.select("doc", "bands"))
    out = _with_comp(own.select("doc_id", "digest", "doc", "once"), label, "doc", "class_id")
    sizes = out.groupBy("doc").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id")).groupBy("class_id").agg(F.sum("n").alias("class_size"))
    return out.join(sizes.withColumnRenamed("class_id", "_id"), F.col("class_id").eqNullSafe(F.col("_id"))).select("doc_id", "digest", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("once")).alias("kept"))


def _classified_apart(own: DataFrame, texts: DataFrame) -> DataFrame:
    """The same where an id (or null) has rows of different words: each word sequence is a node with a number of its own."""
    nodes = staged(own.filter("doc_id <=> doc and once").select("digest", "doc", "bands").withColumn("node", F.monotonically_increasing_id()), "nodes")
    known = nodes.dropna(subset=["doc"])
    said = texts.withColumn("digest", word_digest(F.col("text"))).join(known.select("doc", "digest", "node"), ["doc", "digest"])
    said = said.select(F.col("node").alias("doc"), "text").dropDuplicates(["doc"])
    label = link(said, known.select(F.col("node").alias("doc"), "bands"))
    sizes = own.groupBy("digest").agg(F.count("*").alias("n"))
    members = staged(_with_comp(nodes.select("digest", "doc", "node"), label, "node", "comp").join(sizes, "digest"), "members")
    heads = members.groupBy("comp").agg(F.min(F.struct("doc", "node")).alias("head"), F.sum("n").alias("class_size"))
    named = members.join(heads, "comp").select("digest", F.col("head.doc").alias("class_id"), "class_size", (F.col("node") == F.col("head.node")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("once") & F.col("first")
    return own.join(named, "digest").select("doc_id", "digest", "class_id", "class_size", kept.alias("kept"))


def _single(texts: DataFrame) -> DataFrame:
    """One text for each id: where rows repeat an id, the greatest."""
    if texts.groupBy("doc").count().filter("count > 1").isEmpty():
        return texts
    return texts.groupBy("doc").agg(F.max("text").alias("text"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``near_classes`` keeps, with all their columns; of rows that repeat id and words, ``first_of``."""
    keep = staged(_classified(docs).filter("kept").select(F.col("doc_id").alias("_dw_id"), F.col("digest").alias("_dw_digest")), "kept")
    if exact_dedup.keep_repeats(docs).isEmpty():
        return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_dw_id"]), "left_semi").select(*docs.columns)
    same = docs.withColumn("_dw_d", word_digest(docs["text"]))
    out = same.join(keep, same["doc_id"].cast("long").eqNullSafe(keep["_dw_id"]) & (same["_dw_d"] == keep["_dw_digest"]), "left_semi")
    return exact_dedup.first_of(out, ["doc_id", "_dw_d"], docs.columns)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
