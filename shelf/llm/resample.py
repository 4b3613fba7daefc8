"""Quality classifier: importance resampling with hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelf.llm import textbytes as tb
from shelf.session import write_down

SEED = 7
BINS = 1024
BUCKETS = 1 << 18
MAX_LABELLED = 100_000
#: Standard errors (signed root of the likelihood ratio) by which more toxic documents than others must hold an n-gram.
TOXIC_ERRORS = 4.5
#: Times as often, at least, a toxic document must hold an n-gram as another: with many labels, small differences are sure too.
TOXIC_TIMES = 10.0
#: Share of the raw model in the target model: an n-gram that no target text holds costs at most its logarithm.
RAW_SHARE = 0.5
#: A text weighs as if it had so many n-grams, whatever its length.
NOMINAL = 1024
#: What a toxic document loses in log weight: it comes after all others.
TOXIC_LOSS = 1e9
_KIND = np.full(256, 1, np.uint8)  # words; every byte of a longer character is a word byte
_KIND[:128] = 2  # signs
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[np.flatnonzero(tb.WHITE)] = 0
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngrams(chunk: tb.Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all word and sign n-grams (n = 1, 2) of a chunk, with their text numbers.
    A pair of equal tokens is one n-gram of its own, whatever the token."""
    start, end, text = tb.tokens(chunk.data, chunk.bounds, _KIND)
    h = tb.range_hash(tb.prefix_hash(chunk.data), start, end)
    both = text[1:] == text[:-1]
    pair = tb.mixed(h[:-1] * np.uint64(3) + h[1:])
    pair[h[:-1] == h[1:]] = _REPEAT
    all_h = np.concatenate([h, pair[both]])
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    return (all_h >> shift).astype(np.int64), np.concatenate([text, text[1:][both]])


def labelled_sample(labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, target, toxic, good, fit) of at most ``limit`` labelled documents, those with the smallest hashes. Target:
    quality 1 and not toxic; a document labelled twice is a target only if every label says so, and toxic if one
    does. Rows without doc_id, or with neither quality nor toxic, are left out. ``fit`` (four fifths) marks those that the
    models learn from; the others set the cuts."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None)
    each = (
        labels.withColumn("toxic", toxic.cast("int"))
        .filter("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy("doc_id")
        .agg((F.min("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
        .withColumn("target", F.col("good") & ~F.coalesce("toxic", F.lit(False)))
    )
    return each.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(limit).select(
        "doc_id", "target", "toxic", "good", (F.pmod(F.col("_h"), F.lit(5)) != 0).alias("fit")
    )


_COUNTS = ("raw", "target", "toxic", "clean", "toxic_docs", "clean_docs")


def count_ngrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target, toxic, clean, toxic_docs, clean_docs): n-gram counts of all texts, of those with
    ``target`` true, of those with ``toxic`` true and false, and in how many of the last two it is. One row per
    task and bucket leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {c: np.zeros(buckets, np.int64) for c in _COUNTS}
        for batch in batches:
            marks = batch.column("toxic")
            chosen = {
                "target": batch.column("target").fill_null(False).to_numpy(zero_copy_only=False),
                "toxic": marks.fill_null(False).to_numpy(zero_copy_only=False),
                "clean": ~marks.fill_null(True).to_numpy(zero_copy_only=False),
            }
            for chunk in tb.chunks(batch.column("text")):
                b, text = ngrams(chunk, buckets)
                totals["raw"] += np.bincount(b, minlength=buckets)
                for kind, rows in chosen.items():
                    there = rows[chunk.first : chunk.last][text]
                    if not there.any():
                        continue
                    totals[kind] += np.bincount(b[there], minlength=buckets)
                    if kind != "target":
                        once = np.unique(text[there].astype(np.int64) * buckets + b[there]) % buckets
                        totals[f"{kind}_docs"] += np.bincount(once, minlength=buckets)
        some = np.flatnonzero(totals["raw"])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(totals[c][some]) for c in _COUNTS)], ["bucket", *_COUNTS])

    rows = docs.select("text", "target", "toxic").mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def bucket_counts(counts: DataFrame, buckets: int = BUCKETS) -> dict[str, np.ndarray]:
    """Counts as arrays over all buckets. At most ``buckets`` rows reach the driver."""
    found = {c: np.zeros(buckets) for c in _COUNTS}
    for r in counts.select("bucket", *_COUNTS).toLocalIterator():
        for c, n in zip(_COUNTS, r[1:]):
            found[c][r[0]] = n
    return found


def log_ratios(counts: dict[str, np.ndarray]) -> np.ndarray:
    """log(target share / raw share) of every bucket. The target model is mixed with the raw one, so that n-grams which few
    labelled texts happen to hold do not decide. Zeros if there is no target text."""
    raw, target = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    q = (raw + 1) / (raw + 1).sum()
    p = (1 - RAW_SHARE) * target / target.sum() + RAW_SHARE * q
    return (np.log(p) - np.log(q)).astype(np.float32)


def toxic_ratios(counts: dict[str, np.ndarray], n_toxic: int, n_clean: int) -> np.ndarray:
    """log(share in toxic texts / share in others) of every n-gram that surely, and TOXIC_TIMES as often, is in toxic
    documents; all other n-grams are one kind with one ratio, so that a long text needs as dense evidence as a short one. Zeros
    if there are no such n-grams."""
    a, c = counts["toxic_docs"], counts["clean_docs"]

    def xlogx(x) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-12))

    cells = xlogx(a) + xlogx(c) + xlogx(n_toxic - a) + xlogx(n_clean - c)
    sides = xlogx(a + c) + xlogx(n_toxic + n_clean - a - c) + xlogx(n_toxic) + xlogx(n_clean)
    sure = (2 * (cells - sides + xlogx(n_toxic + n_clean)) > TOXIC_ERRORS**2) & ((a + 0.5) * (n_clean + 1) > TOXIC_TIMES * (c + 0.5) * (n_toxic + 1))
    toxic, clean = ((counts[k] + 0.5) / (counts[k].sum() + 1) for k in ("toxic", "clean"))
    if not sure.any() or not n_toxic or not n_clean:
        return np.zeros(len(a), np.float32)
    # where the sure n-grams are all there is, the rest decides nothing
    rest = np.log(max(1 - toxic[sure].sum(), 1e-9) / max(1 - clean[sure].sum(), 1e-9))
    return np.where(sure, np.maximum(np.log(toxic / clean), 0), min(rest, 0)).astype(np.float32)


def log_weights(docs: DataFrame, ratios: np.ndarray, toxic: np.ndarray) -> DataFrame:
    """``docs`` without text, with n_grams, log_weight and toxic_score: NOMINAL times the mean log ratio of the text's
    n-grams, and the sum of their toxic log ratios."""
    shared = docs.sparkSession.sparkContext.broadcast((ratios, toxic))
    keep = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, evidence = shared.value
        for batch in batches:
            n, s, t = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for chunk in tb.chunks(batch.column("text")):
                b, text = ngrams(chunk, len(table))
                n[chunk.first : chunk.last] = np.bincount(text, minlength=len(chunk))
                mine = slice(chunk.first, chunk.last)
                s[mine] = NOMINAL * np.bincount(text, table[b], minlength=len(chunk)) / np.maximum(n[mine], 1)
                t[chunk.first : chunk.last] = np.bincount(text, evidence[b], minlength=len(chunk))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n), pa.array(s), pa.array(t)], [*keep, "n_grams", "log_weight", "toxic_score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(score, f"{schema}, n_grams long, log_weight double, toxic_score double")


def gumbel_keys(scored: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``key``: log_weight plus Gumbel noise drawn from doc_id, so that a repeated run draws alike."""
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(2.0**53)
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(df: DataFrame, key: str, k: int):
    """The k-th largest value of ``key`` (not null) by narrowing bins; the driver sees ``BINS`` rows a round.
    None if k < 1 or there are fewer rows."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or n < k:
        return None
    while low < high:
        width = (high - low) / BINS
        place = F.least(F.lit(BINS - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        bins = (
            df.filter((F.col(key) >= low) & (F.col(key) <= high))
            .groupBy(place.alias("place"))
            .agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
            .orderBy(F.desc("place"))
            .collect()
        )
        for b in bins:
            if k <= b["n"]:
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def top_k(keyed: DataFrame, k: int) -> DataFrame:
    """Adds ``kept``: true for the k rows with the largest ``key``; of equal keys those with the smaller doc_id
    stay (null counts as smallest). Rows equal in both share their fate."""
    cut = kth_largest(keyed, "key", k)
    if cut is None:
        return keyed.withColumn("kept", F.lit(k > 0))
    tied = keyed.filter(F.col("key") == cut).select((-F.coalesce("doc_id", F.lit(-(2**62)))).alias("order"))
    last = kth_largest(tied, "order", k - keyed.filter(F.col("key") > cut).count())
    return keyed.withColumn(
        "kept", (F.col("key") > cut) | ((F.col("key") == cut) & (-F.coalesce("doc_id", F.lit(-(2**62))) >= F.lit(last)))
    )


def calibrated_cut(keyed: DataFrame) -> float | None:
    """The lowest key that best separates targets from the other labelled rows (largest sum of the share of
    targets at or above it and of others below it). None where one kind is missing. Labelled documents, of which the
    sample has a stated number, reach the driver, one row for each doc_id."""
    rows = keyed.filter("target is not null").groupBy("doc_id").agg(F.min("key").alias("key"), F.min("target").alias("target")).toPandas()
    keys, target = rows["key"].to_numpy(), rows["target"].to_numpy().astype(bool)
    if target.all() or not target.any():
        return None
    order = np.argsort(keys, kind="stable")
    keys, target = keys[order], target[order]
    below = np.searchsorted(keys, keys, "left")
    good = np.concatenate([[0], np.cumsum(target)])[below]
    gain = (below - good) / (~target).sum() - good / target.sum()
    return float(keys[int(np.argmax(gain))])


def toxic_limit(scored: DataFrame, n_toxic: int, n_clean: int) -> float:
    """The toxic score above which a document is toxic: what best separates held-out toxic rows (``toxic``) from
    others, at least the log odds against toxic among labelled documents, where it is as likely as not."""
    rows = scored.filter("toxic is not null").select("doc_id", (-F.col("toxic_score")).alias("key"), (~F.col("toxic")).alias("target"))
    cut = calibrated_cut(rows)
    odds = float(np.log(max(n_clean, 1) / max(n_toxic, 1)))
    return max(0.0, odds, -cut if cut is not None else 0.0)


class Models:
    """What is learned from the labels and all texts: the two tables of log ratios, and the cuts."""

    def __init__(self, ratios: np.ndarray, toxic: np.ndarray, toxic_cut: float = 0.0, cut: float | None = None):
        self.ratios, self.toxic, self.toxic_cut, self.cut = ratios, toxic, toxic_cut, cut

    def keeps(self) -> Column:
        """Over ``key`` and ``toxic_score``: not toxic, and at or above the cut where there is one."""
        passes = F.lit(True) if self.cut is None else F.col("key") >= self.cut
        return (F.col("toxic_score") <= self.toxic_cut) & passes


def _scored(docs: DataFrame, labels: DataFrame, seed: int, max_labelled: int) -> tuple[DataFrame, Models]:
    """Written (doc_id, target, toxic, n_grams, log_weight, toxic_score, key) of every document, and the models."""
    sample = write_down(labelled_sample(labels, max_labelled), "labelled")
    sizes = sample.filter("fit").agg(F.count_if("toxic"), F.count_if(~F.col("toxic"))).first()
    sample = F.broadcast(sample.select("doc_id", F.col("target").alias("_t"), F.col("toxic").alias("_x"), "good", "fit"))
    marked = docs.select("doc_id", "text").join(sample, "doc_id", "left")
    counts = bucket_counts(count_ngrams(marked.select("text", (F.col("_t") & F.col("fit")).alias("target"), F.when(F.col("fit"), F.col("_x")).alias("toxic"))))
    # the cut of quality is set by good rows that are not toxic and by bad ones; toxic rows have a cut of their own
    held = marked.withColumn("target", F.when(~F.col("fit") & (F.col("_t") | ~F.col("good")), F.col("_t")))
    held = held.withColumn("toxic", F.when(~F.col("fit"), F.col("_x"))).drop("_t", "_x", "good", "fit")
    models = Models(log_ratios(counts), toxic_ratios(counts, *sizes))
    keyed = write_down(gumbel_keys(log_weights(held, models.ratios, models.toxic), seed), "resampled")
    models.toxic_cut, models.cut = toxic_limit(keyed, *sizes), calibrated_cut(keyed)
    return keyed, models


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept) of every document.

    The raw model counts the n-grams of every whole text, the target model those of a bounded sample of
    documents labelled as good and not toxic. The log weight is the mean log ratio of the two models over the text, as if it
    had NOMINAL n-grams, so length does not decide; Gumbel noise is added and the k largest keys stay. A second pair of
    models, of texts labelled toxic and not, finds toxic documents; these lose TOXIC_LOSS, so they only stay where ``k``
    leaves room for them. Without ``k`` it is the number of documents, toxic ones aside, at or above the key that best
    separates held-out rows of good and bad quality; without labels of both kinds all others stay.

    Null and empty texts weigh 0; very long texts count whole. Repeated rows draw the same noise. Other columns of
    ``docs`` are not read.
    """
    keyed, models = _scored(docs, labels, seed, max_labelled)
    if k is None:
        k = keyed.filter(models.keeps()).count()
    loss = F.when(F.col("toxic_score") > models.toxic_cut, TOXIC_LOSS).otherwise(0.0)
    keyed = keyed.withColumn("key", F.col("key") - loss).withColumn("log_weight", F.col("log_weight") - loss)
    return top_k(keyed.drop("toxic", "toxic_score"), k).drop("target")


def kept_documents(docs: DataFrame, labels: DataFrame, seed: int = SEED, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that :func:`resampled` keeps, with all their columns, whatever their names. Texts are scored once
    more with the cuts at hand and leave or stay where they are, so none shuffles."""
    _, models = _scored(docs, labels, seed, max_labelled)
    names = docs.columns
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    kept = gumbel_keys(log_weights(packed, models.ratios, models.toxic), seed).filter(models.keeps())
    return kept.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])
