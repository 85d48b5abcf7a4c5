"""Language identification, word first with backoff to shorter and shorter character n-grams.

A known word scores its log frequency in each language. An unseen word is cut, with its borders, into
character n-grams of the longest order of which at least half are known, down to single characters, and
scores their mean log frequency. A text's score in a language is the sum over its words; the
prediction's score is the share of the best language after scaling by the square root of the number of
words, so it lies between 0 and 1.

Learning: at most about ``docs_per_lang`` labelled texts a language (chosen by a hash of the text), whose
words are counted in Spark. All their words and n-grams make the model, as sorted hashes and logs in single precision;
the sample alone bounds its size, so that it can be sent to every executor. Texts without a
label or without text teach nothing. Prediction reads whole texts and nothing but the text.

Defined results: null text, or none with a letter, gives ``und`` with score 0, as does a model that has
learned no language; ties go to the first language by code point; repeated rows get equal
predictions; input columns named like the result's are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches, table

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
_LETTER = re.compile(r"[^\W\d_]")
COLUMNS = ("lang_pred", "score")


def _points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with their borders, and each word's start and length."""
    points = np.frombuffer((b"^" + b"$^".join(words) + b"$").decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    start = np.flatnonzero(points == 94)  # no word holds a border
    return points, start, np.diff(np.append(start, len(points)))


def _grams(points: np.ndarray, start: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words (a shorter word is one), the word of each, and how many a word has."""
    count = np.maximum(length - n + 1, 1)
    owner = np.repeat(np.arange(len(start)), count)
    at, size = K.spread(start, count), np.minimum(length, n)[owner]
    h = np.full(len(at), K.seeded(n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            now = (h ^ points[np.minimum(at + i, len(points) - 1)]) * np.uint64(0xFF51AFD7ED558CCD)
            h = np.where(i < size, now ^ now >> np.uint64(32), h)
    return K.mix(h), owner, count


def _logs(f: np.ndarray) -> np.ndarray:
    return np.log((f + 0.5) / (f.sum(0) + 0.5 * max(1, len(f)))).astype(np.float32)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where wanted hashes are, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted hashes of known words
    logs: np.ndarray  # (words, languages)
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # the same of n-grams, by order

    def unseen(self, words: list[bytes]) -> np.ndarray:
        """Scores of words that are not known."""
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        points, start, length = _points(words)
        left = np.arange(len(words))
        for n in ORDERS:
            h, owner, count = _grams(points, start[left], length[left], n)
            keys, logs = self.grams[n]
            at, known = _find(keys, h)
            at, owner = at[known], owner[known]
            hits = np.bincount(owner, minlength=len(left))
            good = (hits > 0) & (2 * hits >= count)
            for j in range(len(self.langs)):
                total = np.bincount(owner, weights=logs[at, j], minlength=len(left))
                out[left[good], j] = total[good] / hits[good]
            left = left[~good]
            if not len(left):
                break
        return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000) -> Model:
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    totals = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(totals, key=lambda x: x.encode())
    if not langs:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0)), {})
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, docs_per_lang / totals[x]))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000)
    # the same words as K.LETTERS finds: a-z and every character beyond ASCII
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z\x{80}-\x{10FFFF}]+"), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow()  # as many as the sample has words, at most
    return fit(counts.column("lang").to_pylist(), counts.column("word"), counts.column("n").to_numpy(), langs)


def fit(lang: list[str], word: pa.ChunkedArray, n: np.ndarray, langs: list[str]) -> Model:
    at = {x: i for i, x in enumerate(langs)}
    coded = word.cast(pa.string()).combine_chunks().dictionary_encode()
    vocabulary = coded.dictionary
    freq = np.zeros((len(vocabulary), len(langs)))
    np.add.at(freq, (coded.indices.to_numpy(), np.array([at[x] for x in lang], np.int64)), n)
    hashes = np.concatenate([K.words(vocabulary.slice(i, 50_000), K.LETTERS).hash for i in range(0, len(vocabulary), 50_000)] or [np.zeros(0, np.uint64)])
    order = np.argsort(hashes)
    weights = np.log1p(freq)
    grams = {}
    for k in ORDERS:
        keys, sums = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        for i in range(0, len(vocabulary), 50_000):
            h, owner, _ = _grams(*_points([x.encode() for x in vocabulary.slice(i, 50_000).to_pylist()]), k)
            new, which = np.unique(h, return_inverse=True)
            part = np.stack([np.bincount(which, weights=weights[i + owner, j]) for j in range(len(langs))], axis=1)
            both, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros((len(both), len(langs)))
            total[where[: len(keys)]] += sums
            total[where[len(keys) :]] += part
            keys, sums = both, total
        grams[k] = keys, _logs(sums)
    return Model(langs, hashes[order], _logs(freq)[order], grams)


def _predict(model, text_col: str, out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for whole in batches:
            for batch in K.slices(whole, text_col):
                texts = [None if t is None else t.lower() for t in batch.column(text_col).to_pylist()]
                letters = [bool(t and _LETTER.search(t)) for t in texts]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if m.langs:
                    w = K.words(pa.array(texts, pa.string()), K.LETTERS)
                    uniq, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
                    vectors = np.zeros((len(uniq), len(m.langs)))
                    at, known = _find(m.keys, uniq)
                    vectors[known] = m.logs[at[known]]
                    new = np.flatnonzero(~known)
                    vectors[new] = m.unseen([w.data[a:b].tobytes() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)])
                    total = np.stack([np.bincount(w.doc, weights=vectors[inverse, j], minlength=len(texts)) for j in range(len(m.langs))], axis=1)
                    n = np.maximum(np.diff(w.bounds), 1)
                    z = (total - total.max(1, keepdims=True)) / np.sqrt(n)[:, None]
                    p = np.exp(z)
                    p /= p.sum(1, keepdims=True)
                    best = total.argmax(1)
                    for d in np.flatnonzero(np.array(letters) & (np.diff(w.bounds) > 0)):
                        lang[d], score[d] = m.langs[best[d]], p[d, best[d]]
                columns = {name: batch.column(name) for name in batch.schema.names} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out], schema=out)

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of docs with lang_pred and score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    docs = docs.drop(*COLUMNS)
    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), text_col, to_arrow_schema(schema)), schema)


def fold(id_col: str = "doc_id") -> Column:
    """Held out: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~fold()))
    return identify(docs.select("doc_id", fold().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
