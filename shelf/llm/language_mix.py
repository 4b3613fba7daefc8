"""Language identification by multilingual mixture inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from shelf.llm import textbytes as tb

BUCKETS = 1 << 14
MAX_LANGUAGES = 1000
ITERATIONS = 12
UNKNOWN = "und"
_LETTER = tb.LOWER.copy()
_LETTER[:128][~np.isin(np.arange(128), [*range(65, 91), *range(97, 123)])] = 0x20


def held_out(doc_id: Column) -> Column:
    """True for documents that the model never learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def letter_trigrams(chunk: tb.Chunk, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words with their edges, and their text numbers. Everything but letters
    and non-ASCII bytes counts as one space."""
    data = np.full(len(chunk.data) + len(chunk) + 1, 0x20, np.uint8)
    shifted = chunk.bounds + np.arange(len(chunk) + 1)
    keep = np.ones(len(data), bool)
    keep[shifted] = False
    data[keep] = _LETTER[chunk.data]
    text = np.repeat(np.arange(len(chunk)), np.diff(shifted))
    text = np.append(text, len(chunk))
    solid = np.ones(len(data), bool)
    solid[:-1] = (data[1:] != 0x20) | (data[:-1] != 0x20)  # the last of a run of spaces stays, the next text's own
    data, text = data[solid].astype(np.uint32), text[solid]
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    whole = (text[:-2] == text[2:]) | (data[2:] == 0x20)
    whole &= data[1:-1] != 0x20
    h = (code * np.uint32(2654435761)) >> np.uint32(32 - int(buckets).bit_length() + 1)
    return h[whole].astype(np.int64), text[:-2][whole]


def count_trigrams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over every whole text with a language. One row per task, language and bucket leaves a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for chunk in tb.chunks(batch.column("text")):
                b, text = letter_trigrams(chunk, buckets)
                both = np.bincount(number[chunk.first : chunk.last][text] * buckets + b, minlength=len(names) * buckets)
                for name, row in zip(names, both.reshape(-1, buckets)):
                    totals[name] = totals[name] + row if name in totals else row
        for name, row in totals.items():
            some = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(row[some])], ["lang", "bucket", "n"])

    rows = docs.select("lang", "text").filter("lang is not null").mapInArrow(count, "lang string, bucket long, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def language_models(counts: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the smoothed share of every bucket (buckets x languages). The driver gets at
    most ``MAX_LANGUAGES`` x ``buckets`` counts; more languages are an error, as lang then holds something else."""
    if counts.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found: dict[str, np.ndarray] = {}
    for lang, bucket, n in counts.toLocalIterator():
        found.setdefault(lang, np.zeros(buckets))[bucket] = n
    langs = sorted(found)
    if not langs:
        return [], np.zeros((buckets, 0))
    n = np.stack([found[x] for x in langs], 1)
    everything = (n.sum(1, keepdims=True) + 1) / (n.sum() + buckets)
    return langs, (n + 100 * everything) / (n.sum(0) + 100)


def _mixture(p: np.ndarray, c: np.ndarray, text: np.ndarray, first: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after expectation-maximisation and log likelihoods. ``p``: likelihoods of the n-grams in every
    language, ``c``: their counts, sorted by ``text``; ``pi``: where to start, zero for languages left out."""
    total = np.add.reduceat(c, first)[:, None]
    for _ in range(ITERATIONS):
        share = p * pi[text]
        share *= (c / share.sum(1))[:, None]
        pi = np.add.reduceat(share, first, axis=0) / total
    like = np.add.reduceat(c * np.log((p * pi[text]).sum(1)), first)
    return pi, like


def language_proportions(chunk: tb.Chunk, model: np.ndarray) -> np.ndarray:
    """Language proportions of every text of a chunk (texts x languages); zeros where there is no n-gram.

    For each text, sets of its 1, 2, ... likeliest languages by a mixture over all of them are fitted by
    expectation-maximisation; a further language is taken while it raises the log likelihood by more than half
    the log of the number of n-grams plus the log of the number of languages (the choice among them)."""
    buckets, n_langs = model.shape
    out = np.zeros((len(chunk), n_langs))
    b, text = letter_trigrams(chunk, buckets)
    if not len(b) or not n_langs:
        return out
    key, c = np.unique(text * buckets + b, return_counts=True)
    c = c.astype(float)
    where, p = key // buckets, model[key % buckets]
    names, first = np.unique(where, return_index=True)
    text = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(where))))
    alone = np.add.reduceat(c[:, None] * np.log(p), first, axis=0)
    best = alone.argmax(1)
    pi = np.zeros((len(names), n_langs))
    pi[np.arange(len(names)), best] = 1
    like = alone.max(1)
    if n_langs > 1:
        mix, _ = _mixture(p, c, text, first, np.full_like(pi, 1 / n_langs))
        mix[np.arange(len(names)), best] += 1  # the likeliest single language comes first
        order = np.argsort(-mix, axis=1, kind="stable")
        penalty = 0.5 * np.log(np.maximum(2, np.add.reduceat(c, first))) + np.log(n_langs)
        open_ = np.arange(len(names))
        for k in range(2, n_langs + 1):
            start = np.zeros((len(open_), n_langs))
            np.put_along_axis(start, order[open_, :k], 1 / k, axis=1)
            mine = np.isin(text, open_)
            sub = np.searchsorted(open_, text[mine])
            sub_first = np.searchsorted(sub, np.arange(len(open_)))
            new, new_like = _mixture(p[mine], c[mine], sub, sub_first, start)
            better = new_like - like[open_] > penalty[open_]
            open_, new, new_like = open_[better], new[better], new_like[better]
            pi[open_], like[open_] = new, new_like
            if not len(open_):
                break
    out[names] = pi
    return out


def identify_languages(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, proportions) of every whole text: the language with the largest proportion (of
    equal ones the first in the alphabet), that proportion, and all proportions above 0 by language. ``und`` and
    0 for null texts, texts without a letter, and where nothing was learned. Only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            text = batch.column("text")
            lettered = [t is not None and any(map(str.isalpha, t)) for t in (x.as_py() for x in text)]
            pi = np.concatenate([np.zeros((0, len(names)))] + [language_proportions(chunk, table) for chunk in tb.chunks(text)])
            if names:
                empty = pi.sum(1) == 0
                pi[empty] = 1 / len(names)
            best = pi.argmax(1) if names else []
            known = [ok and bool(names) for ok in lettered]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known)] if names else [UNKNOWN] * batch.num_rows, pa.string()),
                    pa.array([min(1.0, float(row[k])) if ok else 0.0 for row, k, ok in zip(pi, best, known)] if names else [0.0] * batch.num_rows, pa.float64()),
                    pa.array([{n: float(x) for n, x in zip(names, row) if x > 0} if ok else {} for row, ok in zip(pi, known)], pa.map_(pa.string(), pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "proportions"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(identify, f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")


def learn_languages(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Models from text and lang of every document that is not held out."""
    return language_models(count_trigrams(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text")))
