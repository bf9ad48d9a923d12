"""Toxicity scores of a factorization machine over hashed terms.

A document's terms are its words and its words' beginnings, hashed into a fixed space. The machine adds, to a
linear weight for each term, a weight for every pair of terms: the product of their factor vectors. Its terms
are those of the labelled sample that tell the labels apart best (chi-squared), and those of the pairs that do so
better than their terms by themselves: a group's name that is harmless alone counts beside an insult.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extended, rest, text_bytes, with_columns

#: Most labelled rows that the machine is fitted on, those with the smallest id hashes: one task holds their term numbers.
SAMPLE_ROWS = 20_000
SPACE_BITS, TERMS, FACTORS = 20, 4096, 4
#: All pairs of the FREQUENT most frequent terms are tested; terms of the best pairs, PAIRED at most, join the machine.
#: PAIR_EVIDENCE: chi-squared of a pair beyond that of its terms, as 5 million pairs ask for; PAIR_ROWS: rows in which it occurs.
FREQUENT, PAIRED, PAIR_EVIDENCE, PAIR_ROWS = 3072, 1024, 35.0, 5
EPOCHS, BATCH, RATE, DECAY, SEED = 40, 256, 0.02, 1e-4, 7
WORD = re.compile(r"[^\W_]+")
STEM = 5


def _numbers(word: str) -> tuple[int, ...]:
    """The hashed terms of a word: itself, and its first letters if it has more."""
    mask = (1 << SPACE_BITS) - 1
    own = zlib.crc32(word.encode("utf-8", "replace")) & mask
    return (own, zlib.crc32(b"^" + word[:STEM].encode("utf-8", "replace")) & mask) if len(word) > STEM else (own,)


def terms(text: bytes) -> np.ndarray:
    """Distinct hashed terms of a text, sorted."""
    found = {n for w in set(WORD.findall(text.decode("utf-8", "replace").lower())) for n in _numbers(w)}
    return np.array(sorted(found), np.uint32)


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [terms(t).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "y", "terms"])


def chi_squared(hits: np.ndarray, rows: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Evidence that the share of positive rows differs where a term (or pair) occurs: ``hits`` of its ``rows`` are positive."""
    expected = rows * (positive / max(1, n))
    spread = expected * (n - rows) * max(1e-9, 1 - positive / max(1, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((rows >= 2) & (rows < n), (hits - expected) ** 2 * n / spread, 0.0)


def paired_terms(rows: list[np.ndarray], y: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Terms of the pairs that tell the labels apart and that their own counts don't explain, strongest pairs first."""
    common = np.sort(np.argsort(-every, kind="stable")[:FREQUENT])
    common = common[every[common] >= PAIR_ROWS]
    place = np.full(1 << SPACE_BITS, -1, np.int32)
    place[common] = np.arange(len(common))
    both, toxic = (np.zeros((len(common), len(common)), np.float32) for _ in range(2))
    for at in range(0, len(rows), 1024):
        there = np.zeros((len(rows[at : at + 1024]), len(common)), np.float32)
        for i, r in enumerate(rows[at : at + 1024]):
            own = place[r]
            there[i, own[own >= 0]] = 1
        both += there.T @ there
        there = there[y[at : at + 1024] > 0]
        toxic += there.T @ there
    chi = chi_squared(toxic, both, len(y), max(1.0, float(y.sum()))).astype(np.float32)
    chi[both < PAIR_ROWS] = 0
    alone = np.diag(chi)
    a, b = np.nonzero(np.triu(chi - alone[:, None] - alone > PAIR_EVIDENCE, 1))
    order = np.argsort(-(chi[a, b] - alone[a] - alone[b]), kind="stable")
    found = common[np.stack([a[order], b[order]], 1).ravel()]
    return found[np.sort(np.unique(found, return_index=True)[1])][:PAIRED]


def choose_terms(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` terms with the largest chi-squared against the label, and the terms of telling pairs; all in two documents at least."""
    every, toxic = (np.bincount(np.concatenate(some) if some else np.zeros(0, np.int64), minlength=1 << SPACE_BITS) for some in (rows, [r for r, label in zip(rows, y, strict=True) if label]))
    chi = chi_squared(toxic, every, len(y), max(1.0, float(y.sum())))
    best = np.argsort(-chi, kind="stable")[:most]
    return np.union1d(best[chi[best] > 3.84], paired_terms(rows, y, every))


def machine_output(bias: float, w: np.ndarray, v: np.ndarray, own: np.ndarray) -> float:
    """bias + sum of weights + sum over pairs of <v_i, v_j>, for present terms ``own``."""
    f = v[own]
    return float(bias + w[own].sum() + 0.5 * ((f.sum(0) ** 2).sum() - (f**2).sum()))


def fit(rows: list[np.ndarray], y: np.ndarray) -> dict:
    """Adam on the logistic loss; every run with the same rows gives the same machine."""
    chosen = choose_terms(rows, y, TERMS)
    rng = np.random.default_rng(SEED)
    k = len(chosen)
    w, v, bias = np.zeros(k), rng.normal(0, 0.01, (k, FACTORS)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    place = np.full(1 << SPACE_BITS, -1, np.int32)
    place[chosen] = np.arange(k)
    own = [x[x >= 0] for x in (place[r] for r in rows)]
    m1, m2 = [np.zeros(1), np.zeros(k), np.zeros((k, FACTORS))], [np.zeros(1), np.zeros(k), np.zeros((k, FACTORS))]
    step = 0
    for _ in range(EPOCHS if k else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            sizes = np.array([len(own[i]) for i in pick])
            flat = np.concatenate([own[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            fv = v[flat]
            sums = np.stack([np.bincount(doc, fv[:, f], len(pick)) for f in range(FACTORS)], 1)
            squares = np.bincount(doc, (fv**2).sum(1), len(pick))
            z = bias + np.bincount(doc, w[flat], len(pick)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]
            each = error[doc]
            slope = each[:, None] * (sums[doc] - fv)
            gw = np.bincount(flat, each, k) / len(pick) + DECAY * w
            gv = np.stack([np.bincount(flat, slope[:, f], k) for f in range(FACTORS)], 1) / len(pick) + DECAY * v
            step += 1
            new = []
            for j, (x, g) in enumerate(((np.array([bias]), np.array([error.mean()])), (w, gw), (v, gv))):
                m1[j] = 0.9 * m1[j] + 0.1 * g
                m2[j] = 0.999 * m2[j] + 0.001 * g * g
                new.append(x - RATE * (m1[j] / (1 - 0.9**step)) / (np.sqrt(m2[j] / (1 - 0.999**step)) + 1e-8))
            bias, w, v = float(new[0][0]), new[1], new[2]
    return {"bias": bias, "terms": chosen.astype(np.uint32), "w": w, "v": v}


def _fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("doc_id")
    model = fit([np.frombuffer(t, np.uint32) for t in rows["terms"]], rows["y"].to_numpy(np.float64))
    return pd.DataFrame({"bias": [model["bias"]], "terms": [model["terms"].tobytes()], "w": [model["w"].tobytes()], "v": [model["v"].tobytes()]})


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> dict:
    """A machine for ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic: 0 or 1); rows with a null label or id teach nothing.

    Of several rows of one id one teaches. The driver receives the fitted machine only: (TERMS + PAIRED) x
    (FACTORS + 1) numbers at most.
    """
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # ids and labels alone; `most` bounds what is broadcast
    picked = docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(ids), "doc_id")
    sample = picked.select("doc_id", F.col("y").cast("double"), "t").mapInArrow(_sampled_terms, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("y", T.DoubleType()), T.StructField("terms", T.BinaryType())]))
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("y", "terms")).alias("x")).select("doc_id", "x.*")
    found = sample.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_fit_group, "bias double, terms binary, w binary, v binary").collect()
    if not found:
        return {"bias": 0.0, "terms": np.zeros(0, np.uint32), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    row = found[0]
    return {"bias": row["bias"], "terms": np.frombuffer(bytes(row["terms"]), np.uint32), "w": np.frombuffer(bytes(row["w"])), "v": np.frombuffer(bytes(row["v"])).reshape(-1, FACTORS)}


def _score(shared, gone: set[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        bias, w, v = model["bias"], model["w"], model["v"]
        place = {int(t): i for i, t in enumerate(model["terms"])}
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, value in enumerate(batch.column(batch.schema.get_field_index("_bytes"))):
                own: set[int] = set()
                for word in set(WORD.findall(value.as_py().decode("utf-8", "replace").lower())):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        hit = known[word] = tuple(place[n] for n in _numbers(word) if n in place)
                    if hit:
                        own.update(hit)
                z = machine_output(bias, w, v, np.array(sorted(own), np.int64))
                out[i] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield with_columns(batch, gone, score=pa.array(out), predicted=pa.array((out >= 0.5).astype(np.int32)))

    return score


def score_toxicity(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of ``docs`` with score (0 to 1) and predicted (1 if score >= 0.5).

    The score depends on the text alone: equal texts score alike, null scores as empty; an empty table gives an
    empty result; columns named like an output are replaced.
    """
    docs = docs.select(rest(docs, "score", "predicted", "_bytes")).withColumn("_bytes", text_bytes())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_score(shared, {"_bytes"}), extended(docs.schema, {"_bytes"}, score=T.DoubleType(), predicted=T.IntegerType()))


def fold(doc_id="doc_id"):
    """crc32 of the id as text, mod 5: rows with 0 are held out; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
