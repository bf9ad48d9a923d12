"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words on either side: each place of the window has its own embedding table,
their sum goes through tanh, and a two-level softmax (group, then token in the group) gives the token's
probability. The most frequent words are tokens of their own; rarer ones share tokens by their last letters, and
such a word's probability is its token's, times its share of all words of that token. The shares come from the
exact counts of all words, a table that grows with the input. A document's score is the sum of its words'
conditional log-probabilities.

The documents' tokens are dealt to shards by hashes of the rows, as many shards as the number of words asks for.
In each round the network is trained on a part of the positions of every shard, from the common weights; all rounds
together mask every position once. After a round the shards' weights are averaged, as whole numbers, so that the
weights don't depend on partitions, machines or the order of tasks. Neither the driver nor a task holds more than a
few models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS, Lookup, Staged, extended, hash_words, most_frequent, rest, scramble, some_rows, text_bytes, with_columns

#: Groups x tokens in a group; the last RARE tokens are shared by all rarer words. Token 0 stands beyond the ends.
GROUPS, SIZE, RARE = 32, 64, 512
KNOWN = GROUPS * SIZE - RARE - 1
DEPTH, SIDE, SEED = 16, 2, 3
#: Rounds, each with its share of the positions; positions in a step; step size.
ROUNDS, STEP, RATE = 2, 4096, 0.08
#: Tokens in a shard; most in one row of a shard (a shard of equal rows can have more).
SHARD, ROW = 1 << 22, 1 << 23
SLICES, CHUNK = 16, 1 << 14
#: Most words whose shares every worker holds (the most frequent ones, 24 bytes each); those of all others are joined.
HELD = 1 << 16
#: Weights are averaged in units of 2**-FINE, shares added up in units of 1e-9.
FINE = 20
WORDS = LETTERS.copy()
WORDS[ord("_")] = ord("_")


def hashed(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows with their words' hashes, numbers of words and last letters."""
    for at, to in some_rows(column, most):
        yield at, to, *hash_words(column.slice(at, to - at), WORDS, True)


def shared_token(tails: np.ndarray) -> np.ndarray:
    """Which of the RARE tokens stands for words with these last letters."""
    return (scramble(tails) % np.uint64(RARE)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words with their counts and shared tokens, handed on whenever many have come together."""
    held, size = [], 0

    def out():
        h, b, n = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at = np.unique(h, return_inverse=True)
        bucket = np.zeros(len(word), np.int64)
        bucket[at] = b
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(np.bincount(at, n, len(word)).astype(np.int64))], names=["word", "bucket", "n"])

    for batch in batches:
        for _, _, h, _, tails in hashed(batch.column(0)):
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append((word, shared_token(tails[first]), n))
            size += len(word)
            if size > 2_000_000:
                yield out()
                held, size = [], 0
    if size:
        yield out()


class Vocabulary:
    """``counts`` (word: its hash, bucket, n) has all words of the documents, ``total`` their number.

    ``hashes``, ``tokens`` and ``shares``: the most frequent words (HELD at most), sorted by hash, with their tokens and the
    logarithms of their shares in them; ``sums`` and ``kinds``: words and different words of each shared token.
    """

    def __init__(self, counts: DataFrame, frequent: list, buckets: list, total: int) -> None:
        self.counts, self.total = counts, total
        word, n, bucket = (np.array([r[c] for r in frequent], np.int64) for c in ("word", "n", "bucket"))
        own = np.arange(len(word)) < KNOWN
        self.sums, self.kinds = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64)
        for b in buckets:
            self.sums[b["bucket"]], self.kinds[b["bucket"]] = b["n"], b["kinds"]
        np.subtract.at(self.sums, bucket[own], n[own])
        np.subtract.at(self.kinds, bucket[own], 1)
        order = np.argsort(word.view(np.uint64), kind="stable")
        self.hashes = word.view(np.uint64)[order]
        self.tokens = np.where(own, np.arange(len(word)) + 1, GROUPS * SIZE - 1 - bucket)[order]
        self.shares = np.where(own, 0.0, np.log(np.maximum(n, 1)) - np.log(self.sums[bucket] + 1))[order]

    def plain(self) -> dict:
        """What workers need."""
        return {"hashes": self.hashes, "tokens": self.tokens, "shares": self.shares}


def vocabulary(docs: DataFrame, staged: Staged) -> Vocabulary:
    """The driver receives HELD words and RARE sums at most."""
    found = docs.select(text_bytes().alias("t")).mapInArrow(_counts, "word long, bucket int, n long")
    counts = staged.put(found.groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")), "word_counts")
    frequent = sorted(most_frequent(counts, "n", HELD), key=lambda r: (-r["n"], r["word"]))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect()
    return Vocabulary(counts, frequent, buckets, sum(b["n"] for b in buckets))


class Numbers:
    """Hashes of words to token numbers and, for the held words, the logarithms of their shares."""

    def __init__(self, plain: dict) -> None:
        self.find, self.numbers, self.shares = Lookup(plain["hashes"]), plain["tokens"], plain["shares"]

    def __call__(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, shares (0 for a word that isn't held) and whether a word is held."""
        if not len(self.numbers):
            return GROUPS * SIZE - 1 - shared_token(tails), np.zeros(len(hashes)), np.zeros(len(hashes), bool)
        at = self.find(hashes)
        held = at >= 0
        tokens = self.numbers[at]
        tokens[~held] = GROUPS * SIZE - 1 - shared_token(tails[~held])
        return tokens, np.where(held, self.shares[at], 0.0), held


def with_ends(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of several documents with SIDE zeros before, between and after them."""
    places = np.arange(len(tokens)) + SIDE * (1 + np.repeat(np.arange(len(sizes)), sizes))
    out = np.zeros(len(tokens) + SIDE * (len(sizes) + 1), np.int64)
    out[places] = tokens
    return out


def shapes() -> dict[str, tuple[int, ...]]:
    v = GROUPS * SIZE
    return {"e": (2 * SIDE, v, DEPTH), "c": (DEPTH + 1, GROUPS), "w": (GROUPS, DEPTH + 1, SIZE)}


def start() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return {k: rng.normal(0, 0.05, s).astype(np.float32) for k, s in shapes().items()}


def hidden(p: dict, context: np.ndarray) -> np.ndarray:
    """Layer of the window's tokens (a row for each place of the window), with a constant at the end."""
    s = p["e"][0].take(context[0], 0)
    for i in range(1, 2 * SIDE):
        s += p["e"][i].take(context[i], 0)
    out = np.ones((len(s), DEPTH + 1), np.float32)
    np.tanh(s, out=out[:, :-1])
    return out


def _softmax(z: np.ndarray) -> None:
    """In place, over the last axis."""
    z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order of the targets by group, and each group's part of it."""
    group = (target % GROUPS).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(GROUPS + 1))
    return order, [(g, slice(ends[g], ends[g + 1])) for g in range(GROUPS) if ends[g] < ends[g + 1]]


def log_probabilities(p: dict, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of every target given its window."""
    order, spans = _by_group(target)
    h, target, n = hidden(p, context)[order], target[order], np.arange(len(target))
    z, inner = h @ p["c"], np.empty((len(h), SIZE), np.float32)
    for g, own in spans:
        np.matmul(h[own], p["w"][g], out=inner[own])
    total = np.zeros(len(h))
    for logits, chosen in ((z, target % GROUPS), (inner, target // GROUPS)):
        logits -= logits.max(1, keepdims=True)
        total += logits[n, chosen]
        np.exp(logits, out=logits)
        total -= np.log(logits.sum(1))
    out = np.empty(len(h))
    out[order] = total
    return out


def learn(p: dict, squares: dict, context: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on the mean log-probability of the targets, in place."""
    order, spans = _by_group(target)
    context, target, n = context[:, order], target[order], len(target)
    h = hidden(p, context)
    rows = np.arange(n)
    d = h @ p["c"]
    _softmax(d)
    d[rows, target % GROUPS] -= 1
    grad = {"c": h.T @ d, "w": np.zeros_like(p["w"]), "e": np.empty_like(p["e"])}
    back = d @ p["c"].T
    d = np.empty((n, SIZE), np.float32)
    for g, own in spans:
        np.matmul(h[own], p["w"][g], out=d[own])
    _softmax(d)
    d[rows, target // GROUPS] -= 1
    for g, own in spans:
        np.matmul(h[own].T, d[own], out=grad["w"][g])
        back[own] += d[own] @ p["w"][g].T
    slope = (back[:, :-1] * (1 - h[:, :-1] ** 2)).astype(np.float64).ravel()
    for i in range(2 * SIDE):
        spots = (context[i][:, None] * DEPTH + np.arange(DEPTH)).ravel()
        grad["e"][i] = np.bincount(spots, slope, GROUPS * SIZE * DEPTH).reshape(-1, DEPTH)
    scale = np.float32(1 / np.sqrt(n))
    for k, g in grad.items():
        g *= scale
        squares[k] += g * g
        g /= np.sqrt(squares[k]) + np.float32(1e-6)
        g *= np.float32(RATE)
        p[k] -= g


def windows(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Windows of the positions ``at`` in ``tokens``, which have SIDE ends around every document: a row for each place."""
    return np.stack([tokens[at + o] for o in range(-SIDE, SIDE + 1) if o])


def masked(places: np.ndarray, round_: int, rounds: int) -> np.ndarray:
    """Which places of a shard's row are targets in a round: each in one round of ``rounds``, by a hash."""
    return scramble(places) % np.uint64(rounds) == round_


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in shapes()])


def shaped(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32)
        at += int(np.prod(s))
    return out


def _numbered(shared):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        for batch in batches:
            out = []
            for _, _, h, sizes, tails in hashed(batch.column(2)):
                tokens = numbers(h, tails)[0].astype(np.uint16)
                out += [x.tobytes() for x in np.split(tokens, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["shard", "key", "tokens"])

    return number


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents come sorted by shard: rows of a shard's tokens, with ends around each document."""
    ends = np.zeros(SIDE, np.uint16).tobytes()
    now, parts, size = None, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([ends + ends.join(parts) + ends], pa.binary())], names=["shard", "tokens"])

    for batch in batches:
        for shard, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if parts and (shard != now or size >= ROW):
                yield out()
                parts, size = [], 0
            if tokens:
                now, size = shard, size + len(tokens) // 2
                parts.append(tokens)
    if parts:
        yield out()


def _train(shared, round_: int, rounds: int):
    """Summed weights of all rows of shards that a task has seen, with the number of its steps, in slices."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, steps = None, 0
        for batch in batches:
            for row in batch.column(0):
                p = shaped(np.frombuffer(shared.value, np.float32))
                squares = {k: np.full(s, 1e-3, np.float32) for k, s in shapes().items()}
                tokens = np.frombuffer(row.as_py(), np.uint16).astype(np.int64)
                at = np.flatnonzero(tokens)
                at = at[masked(at, round_, rounds)]
                n = max(1, -(-len(at) // STEP)) if len(at) else 0
                for some in np.array_split(at, n) if n else ():
                    learn(p, squares, windows(tokens, some), tokens[some])
                if n:
                    own = np.rint(_flat(p).astype(np.float64) * (1 << FINE)).astype(np.int64) * n
                    total, steps = own if total is None else total + own, steps + n
        if steps:
            parts = np.array_split(total, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array(np.full(SLICES, steps)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "steps", "weights"])

    return train


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, n, total = None, 0, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([(total / (n * float(1 << FINE))).astype(np.float32).tobytes()], pa.binary())], names=["slice", "weights"])

    for batch in batches:
        for i, k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if i != now:
                if now is not None:
                    yield out()
                now, n, total = i, 0, 0
            total, n = total + np.frombuffer(x, np.int64), n + k
    if now is not None:
        yield out()


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, bytes]:
    """Vocabulary and weights (about 0.7 MB) fitted on all of ``docs``; equal for equal rows, however they are dealt."""
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "lm")
    known, weights = vocabulary(docs, staged), _flat(start()).astype(np.float32).tobytes()
    key = F.xxhash64(*[F.col(c).cast("string") for c in ("doc_id", "text") if c in docs.columns])
    rows = docs.select(F.pmod(key, F.lit(max(1, round(known.total / SHARD)))).alias("shard"), key.alias("key"), text_bytes().alias("t"))
    rows = rows.mapInArrow(_numbered(spark.sparkContext.broadcast(known.plain())), "shard long, key long, tokens binary")
    shards = rows.repartition("shard").sortWithinPartitions("shard", "key", "tokens").mapInArrow(_packed, "shard long, tokens binary")
    shards = staged.put(shards, "shards")
    for r in range(rounds):
        parts = shards.select("tokens").mapInArrow(_train(spark.sparkContext.broadcast(weights), r, rounds), "slice long, steps long, weights binary")
        merged = parts.repartition(SLICES // 4, "slice").sortWithinPartitions("slice").mapInArrow(_average, "slice long, weights binary").collect()
        if merged:
            weights = b"".join(bytes(x["weights"]) for x in sorted(merged, key=lambda x: x["slice"]))
    staged.drop(shards)
    return known, weights


def token_scores(p: dict, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log-probability of every token of documents of ``sizes`` tokens."""
    wide = with_ends(tokens, sizes)
    at = np.flatnonzero(wide)
    return np.concatenate([log_probabilities(p, windows(wide, x), wide[x]) for x in np.array_split(at, max(1, -(-len(at) // CHUNK)))])


def _score(shared, known, gone: set[str]):
    """Documents with their number of tokens, the sum of what the network and the held shares give, and the words that aren't held."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, numbers = shaped(np.frombuffer(shared.value, np.float32)), Numbers(known.value)
        for batch in batches:
            texts, n, total, words = batch.column(batch.schema.get_field_index("_bytes")), [], [], []
            for _, _, h, sizes, tails in hashed(texts):
                tokens, shares, held = numbers(h, tails)
                each = token_scores(p, tokens, sizes) + shares
                ends = np.cumsum(sizes)
                n.append(sizes)
                total.append(np.diff(np.concatenate([[0.0], np.cumsum(each)])[np.concatenate([[0], ends])]))
                rarer = np.concatenate([[0], np.cumsum(~held)])[np.concatenate([[0], ends])]
                words.append(pa.ListArray.from_arrays(pa.array(rarer, pa.int32()), pa.StructArray.from_arrays([pa.array(h[~held].view(np.int64)), pa.array(shared_token(tails[~held]).astype(np.int32))], ["word", "bucket"])))
            yield with_columns(batch, gone, n_tokens=pa.array(np.concatenate(n)), log_likelihood=pa.array(np.concatenate(total)), _words=pa.concat_arrays(words))

    return score


def rare_shares(words: DataFrame, known: Vocabulary) -> DataFrame:
    """``words`` (word, bucket and others; none is held) with the logarithm of the word's share in its token, in 1e-9.

    With n of the N words of a token the share is n / (N + 1); words that the documents don't have share the rest
    with as many others as the token has different words.
    """
    of = lambda numbers: F.element_at(F.lit(numbers.tolist()), F.col("bucket") + 1).cast("double")
    share = F.coalesce(F.log(F.col("_n").cast("double")), -F.log(of(known.kinds) + 1)) - F.log(of(known.sums) + 1)
    counts = known.counts.select("word", F.col("n").alias("_n"))
    return words.join(counts, "word", "left").withColumn("share", F.round(share * 1e9).cast("long")).drop("_n")


def score_documents(docs: DataFrame, model: tuple[Vocabulary, bytes], keep: list[str] | None = None) -> DataFrame:
    """All columns of ``docs``, or those in ``keep``, with n_tokens, log_likelihood (the sum) and mean_log_prob.

    Null and empty texts have no tokens, the sum 0 and a null mean; equal texts score alike; an empty table
    gives an empty result; columns named like an output are replaced.
    """
    outputs = ("n_tokens", "log_likelihood", "mean_log_prob")
    own = [c for c in rest(docs, *outputs) if keep is None or c in keep]
    held = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), held.alias("own"), text_bytes().alias("_bytes"))
    known, weights = model
    sc, staged = docs.sparkSession.sparkContext, Staged(docs.sparkSession, "lm")
    word = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("bucket", T.IntegerType())]))
    kinds = {"n_tokens": T.LongType(), "log_likelihood": T.DoubleType(), "_words": word}
    scored = rows.mapInArrow(_score(sc.broadcast(weights), sc.broadcast(known.plain()), {"_bytes"}), extended(rows.schema, {"_bytes"}, **kinds))
    scored = staged.put(scored, "scores")
    rarer = scored.select("row", F.explode("_words").alias("w")).select("row", "w.*")
    # whole numbers of 1e-9 add up alike in any order
    shares = rare_shares(rarer, known).groupBy("row").agg(F.sum("share").alias("_shares"))
    total: Column = F.round(F.col("log_likelihood") + F.coalesce(F.col("_shares"), F.lit(0)) / 1e9, 6)
    out = scored.drop("_words").join(shares, "row", "left").withColumn("log_likelihood", total)
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(*[F.col(f"own.`{c}`") for c in own], "n_tokens", "log_likelihood", mean.alias("mean_log_prob"))
