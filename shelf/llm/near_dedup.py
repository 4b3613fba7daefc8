"""Near-duplicate documents: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from shelf.llm import textbytes as tb
from shelf.llm.skew import join_groups, perhaps_in
from shelf.operators.graph import connected_components
from shelf.session import spread, write_down

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
BLOCK = 500
SALT_ROWS = 256
#: Equal coordinates that a pair must have to be verified: five standard deviations below what 0.75 gives.
LEAST_EQUAL = int(COORDINATES * 0.75 - 5 * (COORDINATES * 0.75 * 0.25) ** 0.5)
_WORD = (~tb.WHITE).astype(np.uint8)
_SCALE = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 2 * COORDINATES, dtype=np.uint64)
_LOW48, _LOW40 = np.uint64((1 << 48) - 1), np.uint64((1 << 40) - 1)


def shingle_sets(chunk: tb.Chunk, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of every text, as 64-bit hashes; fewer words than ``words`` are one shingle."""
    data = tb.LOWER[chunk.data]
    start, end, text = tb.tokens(data, chunk.bounds, _WORD)
    h = tb.range_hash(tb.prefix_hash(data), start, end)
    n = max(0, len(h) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s += h[j : j + n] * _SCALE[j]
    s = tb.mixed(s)
    first = np.searchsorted(text, np.arange(len(chunk) + 1))
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            sets.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            sets.append(tb.mixed((h[a:b] * _SCALE[words : words + b - a]).sum(keepdims=True)))
        else:
            sets.append(s[:0])
    return sets


def fast_sketch(x: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """A similarity sketch of a set of hashes in ``t`` coordinates (Dahlgaard, Knudsen, Thorup 2017).

    In rounds 0 to t - 1 every element is hashed to one coordinate and a value, and a coordinate keeps the smallest
    (round, value) that it meets; rounds t to 2t - 1 hash all elements to one coordinate each, so every one is
    filled. Rounds stop once all are, after about t log t / |x|. The share of equal coordinates of two sketches
    estimates the similarity with the concentration of independent samples."""
    out, empty = np.zeros(t, np.uint64), np.ones(t, bool)
    at, rounds = 0, -(-7 * t // len(x))
    while at < t and empty.any():
        r = np.arange(at, min(t, at + rounds), dtype=np.uint64)
        v = tb.mixed(x[None, :] ^ _ROUND[r.astype(np.int64)][:, None])
        place = (v >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)
        key = np.sort(((place << np.uint64(48)) | (r[:, None] << np.uint64(40)) | (v & np.uint64(0xFFFFFFFF))).ravel())
        own = (key >> np.uint64(48)).astype(np.int64)
        least = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = least[empty[own[least]]]
        out[own[least]] = key[least] & _LOW48
        empty[own[least]] = False
        at += rounds
    for b in np.flatnonzero(empty):
        out[b] = (np.uint64(t) << np.uint64(40)) | (tb.mixed(x ^ _ROUND[t + b]).min() & _LOW40)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, sketch): the size and digest of a text's set, the hashes of its sketch's
    bands, and a byte of every coordinate. Null bands for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            n, ids, bands, sketches = [], [], [], []
            for chunk in tb.chunks(batch.column("text")):
                for x in shingle_sets(chunk):
                    n.append(len(x))
                    if not len(x):
                        ids.append(None), bands.append(None), sketches.append(None)
                        continue
                    ids.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    s = fast_sketch(x)
                    keys = tb.mixed((s.reshape(BANDS, ROWS) * _SCALE[:ROWS]).sum(1) + number)
                    bands.append(keys.view(np.int64))
                    sketches.append((tb.mixed(s) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "set_id", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>, sketch binary")


def shared_buckets(sets: DataFrame) -> DataFrame:
    """(key, rep) of every band value that two or more different sets share."""
    entries = sets.select(F.explode("bands").alias("key"), F.col("rep"))
    counts = write_down(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "buckets")
    return write_down(join_groups(entries, counts, "key", "members", sets.count() * BANDS), "bucketed")


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): every set b with the smallest set a of a bucket, the one it shares most buckets with."""
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.first("members").alias("members"))
    pairs = join_groups(buckets.drop("members"), pivots, "key", "members", buckets.count()).filter("rep <> a")
    counted = pairs.groupBy(F.col("rep").alias("b"), "a").agg(F.count("*").alias("n"))
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("n"), "a"))
    return counted.withColumn("r", best).filter("r = 1").select("a", "b")


def _placed(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """``buckets`` with the component of each set; a set without links is its own."""
    named = components.select(F.col("node").alias("rep"), "component")
    return buckets.join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def _blocks(buckets: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, i, j, own, members): every block of a bucket, packed into one row, once for each two blocks that it is compared in."""
    placed = _placed(buckets, components)
    parts = placed.groupBy("key", "component").agg(
        F.count("*").alias("n"), F.min("rep").alias("first"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("sign")
    )
    kinds = parts.groupBy("key").agg(
        F.sum("n").alias("m"), F.min("first").alias("first"), F.sum("sign").alias("sign"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")
    ).filter("parts > 1")
    kinds = kinds.groupBy("m", "first", "sign").agg(F.min("key").alias("key"), F.min("main").alias("main"))
    kinds = kinds.select(
        "key", "m", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"),
        F.ceil((F.col("m") - F.col("main.n")) / BLOCK).cast("int").alias("rests"),
    )
    rows = join_groups(placed.select("key", "rep", "component"), write_down(kinds, "kinds"), "key", "m", buckets.count())
    major, h = F.col("component") == F.col("main"), F.xxhash64("rep")
    own = F.when(major, F.pmod(h, F.col("mains"))).otherwise(F.col("mains") + F.pmod(h, F.col("rests"))).cast("int")
    others = F.sequence(F.when(major, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("rests") - 1)
    rows = rows.select("key", "rep", "component", own.alias("own"), others.alias("others")).join(sets.select("rep", "n_shingles", "sketch"), "rep")
    packed = rows.groupBy("key", "own").agg(F.collect_list(F.struct("rep", "component", "n_shingles", "sketch")).alias("members"), F.max("others").alias("others"))
    packed = packed.select("key", "own", "members", F.explode("others").alias("other"))
    return packed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "members")


def open_blocks(buckets: DataFrame, components: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, i, j, own, rep, component): what is left to compare. Buckets whose sets lie in different components are
    split into blocks, those of the largest component apart from the rest, and each two blocks i <= j meet in a task of
    their own, but never two of the largest component. So no task holds a whole bucket, and a large component only meets
    the few sets outside it. A set stays in the task if another there, of a different component and of a fitting size,
    agrees with it in at least LEAST_EQUAL coordinates. Buckets with the same members count once."""
    def compare(blocks: pd.DataFrame) -> pd.DataFrame:
        members = pd.DataFrame([m for block in blocks["members"] for m in block])
        group = members.assign(own=np.repeat(blocks["own"].to_numpy(), [len(x) for x in blocks["members"]]), key=blocks["key"].iloc[0], i=blocks["i"].iloc[0], j=blocks["j"].iloc[0])
        sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), COORDINATES)
        component, n, own = (group[c].to_numpy() for c in ("component", "n_shingles", "own"))
        across = group["i"].iloc[0] != group["j"].iloc[0]
        needed = np.zeros(len(group), bool)
        for k in range(len(group) - 1):
            fits = np.minimum(n[k + 1 :], n[k]) * DENOMINATOR >= np.maximum(n[k + 1 :], n[k]) * NUMERATOR
            other = k + 1 + np.flatnonzero(fits & (component[k + 1 :] != component[k]) & ((own[k + 1 :] != own[k]) | (not across)))
            other = other[(sketch[other] == sketch[k]).sum(1) >= LEAST_EQUAL]
            if len(other):
                needed[other] = needed[k] = True
        return group.loc[needed, ["key", "i", "j", "own", "rep", "component"]]

    rows = _blocks(buckets, components, sets)
    return rows.groupBy("key", "i", "j").applyInPandas(compare, "key long, i int, j int, own int, rep long, component long")


def block_links(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a, b): links between the sets of each two blocks, on whole shingle sets. Links within a component, and those
    that earlier links of the task imply, are left out, so a task gives fewer rows than it takes."""
    texts = perhaps_in(docs.select(F.col("doc_id").alias("rep"), "text"), blocks, "rep")
    rows = texts.join(blocks, "rep")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("rep").sort_values("rep")
        sets = [x for chunk in tb.chunks(pa.array(group["text"], pa.string())) for x in shingle_sets(chunk)]
        size = np.array([len(x) for x in sets])
        rep, own, component = (group[c].to_numpy() for c in ("rep", "own", "component"))
        across = group["i"].iloc[0] != group["j"].iloc[0]
        number, where = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.cumsum(size) - size
        there = np.zeros(len(number), np.int32)
        label = np.unique(component, return_inverse=True)[1]
        a, b = [], []
        for k in range(len(rep) - 1):
            fits = np.minimum(size[k + 1 :], size[k]) * DENOMINATOR >= np.maximum(size[k + 1 :], size[k]) * NUMERATOR
            other = k + 1 + np.flatnonzero(fits & (label[k + 1 :] != label[k]) & ((own[k + 1 :] != own[k]) | (not across)))
            if not len(other):
                continue
            mine = where[first[k] : first[k] + size[k]]
            there[mine] = 1
            both = np.array([there[where[first[x] : first[x] + size[x]]].sum() for x in other.tolist()])
            there[mine] = 0
            for x in other[DENOMINATOR * both >= NUMERATOR * (size[other] + size[k] - both)].tolist():
                if label[x] != label[k]:
                    label[label == label[x]] = label[k]
                    a.append(rep[k]), b.append(rep[x])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return rows.groupBy("key", "i", "j").applyInPandas(link, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets meet the threshold. Texts travel to where the pairs of one ``a`` are
    checked; an ``a`` with many pairs is copied to several tasks."""
    pairs = write_down(pairs.select("a", "b"), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"), F.count("*").alias("n"))
    salts = write_down(salts, "salts")
    members = join_groups(pairs, salts, "a", "n", pairs.count())
    members = members.select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = salts.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    routes = write_down(members.unionByName(heads), "routes")
    texts = perhaps_in(docs.select("doc_id", "text"), routes, "doc_id")
    rows = spread(texts.join(routes, "doc_id").withColumn("member", F.col("doc_id") != F.col("a")), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            a, salt, b = (batch.column(c).to_numpy() for c in ("a", "salt", "doc_id"))
            linked, k = [], 0
            for chunk in tb.chunks(batch.column("text")):
                for x in shingle_sets(chunk):
                    if (a[k], salt[k]) != now:
                        now, head = (a[k], salt[k]), x if a[k] == b[k] else None
                    elif head is not None:
                        both = len(np.intersect1d(head, x, assume_unique=True))
                        if DENOMINATOR * both >= NUMERATOR * (len(head) + len(x) - both) > 0:
                            linked.append(k)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(a[linked], pa.int64()), pa.array(b[linked], pa.int64())], ["a", "b"])

    return rows.select("a", "salt", "doc_id", "text").mapInArrow(verify, "a long, b long").distinct()


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; doc_id must be an integer.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text's set are its distinct shingles of five
    words, or all its words as one shingle if they are fewer. Documents with equal sets are one class. Classes that
    share a band of their sketches are candidates: first each with one partner, then all that are still in different
    components and agree in enough coordinates; every link is confirmed on full sets. Components are those of the
    links of at least 0.75. A pair at exactly 0.75 is missed with a chance of 5 in a million, a more similar one less.

    Null, empty and blank texts have no shingles and stay alone, and so do rows without doc_id (null component).
    Rows that repeat a doc_id are one document for links; keep such ids unique. Other columns are not read.
    """
    signed = write_down(signatures(docs), "signed")
    filled = signed.filter("doc_id is not null and n_shingles > 0")
    classes = write_down(filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    sets = write_down(
        filled.join(classes.select(F.col("rep").alias("doc_id"), F.col("set_id").alias("own")), "doc_id").filter("set_id = own")
        .select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch"), "sets",
    )
    buckets = shared_buckets(sets)
    links = write_down(verified(docs, star_pairs(buckets)), "links")
    blocks = write_down(open_blocks(buckets, connected_components(links), sets), "blocks")
    links = write_down(links.unionByName(block_links(docs, blocks)), "links")
    components = connected_components(links)
    named = classes.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = write_down(named.select("set_id", "members", F.coalesce("component", "rep").alias("component_id")), "named")
    named = join_groups(filled.select("doc_id", "n_shingles", "set_id"), named, "set_id", "members", signed.count())
    named = named.select("doc_id", "n_shingles", "component_id")
    alone = signed.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
