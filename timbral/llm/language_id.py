"""Language identification as multilingual mixture inference.

Training counts byte trigrams for each language over all training documents:
every task adds up one table, and tables meet in a sum by (language, bucket).
A document is a sequence of short spans; each span has a likelihood under each
language.  Expectation-maximisation estimates the share of every language in
the document.  The language set is then chosen by penalised likelihood:
starting from all languages, the one of least share is dropped and the shares
are fitted again, as long as the likelihood falls by less than the penalty for
one more language.  The answer is the language with the largest share.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timbral.llm.decontaminate import normal_form
from timbral.llm.shared import slices, text_bytes

BUCKETS = 1 << 15
#: Trigrams in a span.
SPAN = 48
#: A model has a table of BUCKETS numbers for each language, in the driver and in each task: 64 MB for so many languages.
MOST_LANGUAGES = 500
UNKNOWN = "und"
_SLICE = 2 << 20
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class Model:
    """languages in order; log-probabilities [language, bucket]; log share of each language in training."""

    languages: list[str]
    trigrams: np.ndarray
    prior: np.ndarray


def _trigrams(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each trigram; a text counts with a space before and after it."""
    form, off, _ = normal_form(*text_bytes(part.column("text")))
    spaced = np.concatenate([np.insert(form, off[:-1], 0x20), [0x20, 0x20, 0x20]]).astype(np.uint32)
    off = off + np.arange(len(off))
    n = int(off[-1])
    gram = spaced[:n] | (spaced[1 : n + 1] << np.uint32(8)) | (spaced[2 : n + 2] << np.uint32(16))
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    doc = np.repeat(np.arange(part.num_rows), np.diff(off))
    keep = np.ones(n, bool)
    keep[off[1:] - 1] = False  # the last one would reach into the next text
    return bucket[keep], doc[keep]


def train(docs: DataFrame, most: int = MOST_LANGUAGES) -> Model:
    """The model of docs(text, lang): one pass over all of them.

    Rows without a lang or a text teach nothing; those without a doc_id teach
    like others.  Values of lang are counted before any text is read, and more
    than most of them are an error: no language is left out.
    """

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                index = np.array([names.index(x) for x in langs], np.int64)
                bucket, doc = _trigrams(part)
                table = np.bincount(index[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
                for name, row in zip(names, table, strict=True):
                    found[name] = found.get(name, 0) + row
        for name, row in found.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], names=["lang", "bucket", "n"])

    known = docs.where("lang is not null and text is not null").select("text", "lang")
    n = known.select("lang").distinct().limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} values of lang; a model has {BUCKETS} numbers for each")
    taught = known.mapInArrow(count, "lang string, bucket int, n long")
    rows = taught.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.zeros((len(languages), BUCKETS))
    table[[languages.index(x) for x in rows["lang"]], rows["bucket"]] = rows["n"]
    total = table.sum(axis=1, keepdims=True)
    trigrams = np.log((table + 0.1) / (total + 0.1 * BUCKETS)).astype(np.float32)
    return Model(languages, trigrams, np.log(total[:, 0] / max(total.sum(), 1)))


def _expect(spans: np.ndarray, first: np.ndarray, own: np.ndarray, share: np.ndarray, prior: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares and log-likelihood after so many rounds. spans: [span, language] likelihoods relative to the best; share is 0 outside the set."""
    level = np.zeros(len(first))
    for k in range(rounds + 1):
        joint = spans * share[own]
        total = joint.sum(axis=1)
        total[total <= 0] = 1e-300
        level = np.add.reduceat(np.log(total), first)
        if k < rounds:
            share = (np.add.reduceat(joint / total[:, None], first, axis=0) + prior) * (share > 0)
            share /= share.sum(axis=1, keepdims=True)
    return share, level


def mixtures(model: Model, part: pa.RecordBatch | pa.Table) -> np.ndarray:
    """[document, language]: the share of each chosen language; zeros for a document without trigrams."""
    bucket, doc = _trigrams(part)
    out = np.zeros((part.num_rows, len(model.languages)))
    if not len(bucket) or not model.languages:
        return out
    docs, begin, size = np.unique(doc, return_index=True, return_counts=True)
    nth = np.arange(len(doc)) - np.repeat(begin, size)
    cut = np.flatnonzero(nth % SPAN == 0)
    level = np.stack([np.add.reduceat(row[bucket], cut) for row in model.trigrams], axis=1).astype(np.float64)
    best = level.max(axis=1)
    spans = np.exp(np.maximum(level - best[:, None], -600))
    own = np.searchsorted(docs, doc[cut])
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    count = np.diff(np.append(first, len(own)))
    prior = 0.1 * np.exp(model.prior) + 1e-6
    share, likely = _expect(spans, first, own, np.full((len(docs), len(model.languages)), 1 / len(model.languages)), prior, 12)
    active = np.arange(len(docs))
    while len(active) and len(model.languages) > 1:
        active = active[(share[active] > 0).sum(axis=1) > 1]
        if not len(active):
            break
        rows = np.flatnonzero(np.isin(own, active))
        some = np.searchsorted(active, own[rows])
        at = np.flatnonzero(np.append(True, some[1:] != some[:-1]))
        fewer = share[active].copy()
        fewer[np.arange(len(active)), np.where(fewer > 0, fewer, 2).argmin(axis=1)] = 0
        fewer /= fewer.sum(axis=1, keepdims=True)
        fewer, level = _expect(spans[rows], at, some, fewer, prior, 4)
        penalty = 3 + np.log1p(count[active])
        good = level > likely[active] - penalty
        share[active[good]], likely[active[good]] = fewer[good], level[good]
        active = active[good]
    out[docs] = share
    return out


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all if None) of every row, with lang_pred, score (the predicted language's share) and languages (how many were chosen).

    Of docs only text is read.  A null text, one without a letter, and every
    text under a model without languages is UNKNOWN with score 0.  Ties go to
    the language more frequent in training.  Columns of docs that have the name
    of a new one are replaced.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "languages"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double").add("languages", "integer")

    def predict(batches):
        known = sent.value
        order = np.argsort(-known.prior, kind="stable")
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                share = mixtures(known, part)
                names, scores = [], []
                for text, row in zip(part.column("text").to_pylist(), share, strict=True):
                    if text is None or not row.any() or not _LETTER.search(text):
                        names.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        k = order[row[order].argmax()]
                        names.append(known.languages[k])
                        scores.append(float(min(1.0, row[k])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names), pa.array(scores), pa.array((share > 0).sum(axis=1), pa.int32())], names=keep + new)

    return docs.select(*keep, *(["text"] if "text" not in keep else [])).mapInArrow(predict, schema)


def held_out() -> Column:
    """Whether a document is kept from training: the CRC-32 of its id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
