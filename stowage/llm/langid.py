"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities (buckets x languages, at most ``BUCKETS`` rows), fitted on a bounded
sample of labelled rows and broadcast; documents are scored in batches as a sparse row (bucket indices, row starts)
times that matrix, in numpy.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing labelled
could be learned from; ties go to the language that sorts first; repeated rows are judged once each; other columns
are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import in_sample

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000  # most labelled documents, in expectation, that a model is fitted on
CHUNK = 1 << 20  # characters scored at once
EVIDENCE = 48.0  # n-grams that a text's mean evidence counts as, at most, in its score
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    found = _LETTER.search(text)
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def hashed_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams (one more bucket for those across two texts), and each text's first one."""
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0\0").encode("utf-32-le", "replace"), np.uint32)
    breaks = codes == 0
    one, two, three = codes[:-2], codes[1:-1], codes[2:]
    h1 = one * np.uint32(0x9E3779B1)
    h2 = (h1 ^ two) * np.uint32(0x85EBCA6B)
    h3 = (h2 ^ three) * np.uint32(0xC2B2AE35)
    b1, b2 = breaks[:-2], breaks[:-2] | breaks[1:-1]
    grams = np.stack([np.where(b, np.uint32(BUCKETS), h >> np.uint32(16)) for h, b in ((h1, b1), (h2, b2), (h3, b2 | breaks[2:]))], axis=1)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    return grams.ravel(), starts * 3


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK characters."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= CHUNK:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _clean(text: str | None) -> str:
    return (text or "").lower().replace("\0", " ")


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # languages x (BUCKETS + 1), float32
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.langs:
            return names, scores
        asked = [k for k, t in enumerate(texts) if t and has_letter(t)]
        clean = [_clean(texts[k]) for k in asked]
        for a, b in chunks(clean):
            grams, starts = hashed_grams(clean[a:b])
            totals = np.stack([np.add.reduceat(w[grams], starts) for w in self.weights]).astype(float)
            counts = np.add.reduceat((grams < BUCKETS).astype(np.int32), starts)
            top = np.argmax(totals + self.prior[:, None], axis=0)
            mean = totals / counts * np.minimum(counts, EVIDENCE) + self.prior[:, None]
            odds = np.exp(mean - mean.max(axis=0))
            odds /= odds.sum(axis=0)
            for k, best, share in zip(asked[a:b], top, odds.max(axis=0), strict=True):
                names[k], scores[k] = self.langs[best], float(share)
        return names, scores


def fit(docs: DataFrame, train: Column, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text, lang) where ``train`` holds; a hash of the id draws the sample."""
    labelled = docs.where(train & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per_lang = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs, rows = sorted(per_lang), sum(per_lang.values())
    if not rows:
        return Model([], np.zeros((0, BUCKETS + 1), np.float32), np.zeros(0))
    sample = labelled.where(in_sample("doc_id", sample_docs, rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), BUCKETS + 1), np.int64)
        for batch in batches:
            texts, labels = [_clean(t) for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for lang in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == lang]
                for a, b in chunks(own):
                    sums[langs.index(lang)] += np.bincount(hashed_grams(own[a:b])[0], minlength=BUCKETS + 1)
        of, bucket = np.nonzero(sums[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[of, bucket])], ["lang", "bucket", "n"])

    counts = np.zeros((len(langs), BUCKETS))
    # at most languages x BUCKETS rows, whatever the input
    sums = sample.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    weights = np.concatenate([logs, np.zeros((len(langs), 1))], axis=1).astype(np.float32)
    return Model(langs, weights, np.log([per_lang[x] / rows for x in langs]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` with lang_pred and score; clashing columns of ``docs`` are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*frame.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return frame.mapInArrow(run, schema)
