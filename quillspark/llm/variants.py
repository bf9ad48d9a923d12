"""Spelling variants: words one edit apart, by an index of grams of variable length.

Every gram of two letters is in the dictionary; one that is frequent among the words is extended by a letter, as long
as it stays frequent, up to a longest length. A word is cut into the longest gram of the dictionary at each
place. Which letters decide a gram is known, so for every word there is a bound on the grams that one edit can affect,
wherever it falls and whatever it puts there; of its grams in order of frequency, the rarest, one more than
that bound, are enough: two words one edit apart share one of them, at the same place or the next. The lists of these
grams are merged, and what meets is compared letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, text_bytes

MIN_CHARS, MIN_COUNT, RATIO, LOST = 6, 5, 5, 199
#: Bytes that may stand in runs, the runs of [A-Za-zÀ-ÿ]+ in UTF-8 after A-Z are lower-cased, and bytes that end both.
MAYBE, RUN, GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+"), re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Bytes of a text that are looked at together, and different words that a task counts before it passes them on.
SLICE, HELD_WORDS = 1 << 22, 500_000
#: Lengths of grams. A gram is frequent above a share of 1 / SPREAD of all places, so at most 5 * SPREAD are.
SHORTEST, LONGEST, SPREAD, LEAST_FREQUENT = 2, 6, 1 << 14, 8
#: Rows of a list that are compared with each other as they are; pairs compared at once; letters beyond which words are compared one by one.
LIST, PAIRS, WIDE = 1000, 1 << 20, 48


def runs_of(text: bytes, doc: bytes, lost: int, min_chars: int) -> Iterator[tuple[str, int]]:
    """Words of a text with their counts: runs in lower case, of which those that ``lost`` draws for the document lose a letter."""
    text, start, found, at = text.lower(), zlib.crc32(doc + b":"), Counter(), 0
    while at < len(text):
        gap = GAP.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = gap.start() if gap else len(text)
        found.update(MAYBE.findall(text, at, end))
        at = end
    for some, n in found.items():
        for run in (some,) if some.isascii() else RUN.findall(some):
            if len(run) >= min_chars:
                h, word = zlib.crc32(run, start), run.decode()
                if h % lost == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                if len(word) >= min_chars:
                    yield word, n


def _counts(lost: int, min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in runs_of(text, doc, lost, min_chars):
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield out()
                    total = Counter()
        yield out()

    return count


def _gram_counts(lengths: tuple[int, ...], known):
    """How many places have each gram of ``lengths``; those longer than the shortest only where the gram without the last letters is ``known`` to be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value if known else None
        total, head = Counter(), lengths[0] - 1
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])
        for batch in batches:
            for word in batch.column(0).to_pylist():
                for p in range(len(word) - lengths[0] + 1):
                    if frequent is None or word[p : p + head] in frequent:
                        total.update(word[p : p + k] for k in lengths if p + k <= len(word))
            if len(total) > HELD_WORDS:
                yield out()
                total = Counter()
        yield out()

    return count


def frequent_grams(words: DataFrame, spread: int = SPREAD) -> dict[str, int]:
    """The frequent grams of ``words`` (word) with their counts: a number of grams that does not grow with the words."""
    places = words.agg(F.sum(F.length("word") - 1)).first()[0] or 0
    least = max(LEAST_FREQUENT, places // spread)
    found, known = {}, None
    for lengths in ((2, 3, 4), (5, 6)):
        counts = words.select("word").mapInArrow(_gram_counts(lengths, known), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        found |= {r["gram"]: r["n"] for r in counts.filter(F.col("n") > least).collect()}
        known = words.sparkSession.sparkContext.broadcast(found)
    return found


def longest_gram(n: int, min_chars: int) -> int:
    """The longest gram for words of ``n`` letters and, where such words exist, of n - 1: short enough to leave one that an edit can't affect."""
    return min(LONGEST, n - 3 if n > min_chars else n - 2)


def rare_grams(word: str, longest: int, frequent: dict[str, int]) -> list[tuple[int, str, int]]:
    """Count (0 unless frequent), gram and place of the rarest grams of a word, one more than an edit can affect."""
    n, out = len(word), []
    cover = [0] * (n + 2)
    for p in range(n - SHORTEST + 1):
        to = p + SHORTEST
        while to - p < longest and to < n and word[p:to] in frequent:
            to += 1
        out.append((frequent.get(word[p:to], 0), word[p:to], p))
        # letters p to the last one decide the gram; at the word's end, so does that it ends there
        last = n if to == n and to - p < longest and word[p:to] in frequent else to - 1
        cover[p] += 1
        cover[last + 1] -= 1
    most = here = 0
    for step in cover:
        here += step
        most = max(most, here)
    out.sort()
    return out[: most + 1]


LISTED = "key string, role int, word string, n long"


def _listed(shared, min_chars: int):
    """Every word under its rare grams and their places, for words of its own length (role 0) and as the shorter of two (role 1)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for batch in batches:
            out = []
            for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k = len(word)
                out += [(f"{k}.{p}.{gram}", 0, word, n) for _, gram, p in rare_grams(word, longest_gram(k, min_chars), frequent)]
                more = rare_grams(word, longest_gram(k + 1, min_chars), frequent)
                out += [(f"{k + 1}.{q}.{gram}", 1, word, n) for _, gram, p in more for q in (p, p + 1)]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=["key", "role", "word", "n"])

    return post


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one letter is inserted, deleted or replaced between two words."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_pairs(words: list[str], role: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted lists (``ends``: where each row's list ends), pairs of rows one edit apart; role 0 stands first in a list, and two rows of role 1 are no pair."""
    size = np.array([len(w) for w in words], np.int64)
    wide = max(1, int(size.max()))
    left = np.array([w.encode("latin-1") for w in words], f"S{wide}").view(np.uint8).reshape(-1, wide)
    right = np.array([w.encode("latin-1").rjust(wide, b"\0") for w in words], f"S{wide}").view(np.uint8).reshape(-1, wide)
    later = np.where(role == 0, ends - np.arange(len(words)) - 1, 0)
    up_to, found, at = np.cumsum(later), [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(up_to, (up_to[at - 1] if at else 0) + PAIRS, "right")))
        k = later[at:to]
        i = np.repeat(np.arange(at, to), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        near = np.zeros(len(i), bool)
        same = role[j] == 0
        near[same] = (left[i[same]] != left[j[same]]).sum(1) == 1
        x, y = i[~same], j[~same]
        ahead = np.cumprod(left[x] == left[y], 1, dtype=np.int8).sum(1)
        behind = np.cumprod((right[x] == right[y])[:, ::-1], 1, dtype=np.int8).sum(1)
        near[~same] = ahead + behind >= size[y]
        found.append(np.stack([i[near], j[near]]))
        at = to
    return tuple(np.concatenate(found, 1))


SWEPT = "kind int, key string, role int, word string, n long, other string, m long"


def _swept(most: int | None):
    """Rows come sorted by key and role. Gives near pairs (kind 0: word, n, other, m) and rows of lists longer than ``most`` (kind 1), each under all it leaves without a letter."""
    names = [x.split()[0] for x in SWEPT.split(", ")]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def pairs(key: pa.Array, role: np.ndarray, word: pa.Array, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Lists that are whole."""
        some = (sizes > 1) & (role[starts] == 0)
        rows = np.repeat(some, sizes)
        if not rows.any():
            return
        words, role, n = word.filter(pa.array(rows)).to_pylist(), role[rows], n[rows]
        ends = np.repeat(np.cumsum(sizes[some]), sizes[some])
        long = np.repeat(np.array([len(words[e - 1]) > WIDE for e in np.cumsum(sizes[some]).tolist()]), sizes[some])
        found = [[], []]
        for part, own in ((False, np.flatnonzero(~long)), (True, np.flatnonzero(long))):
            if len(own) and not part:  # all at once
                i, j = near_pairs([words[k] for k in own], role[own], np.searchsorted(own, ends[own]))
                found[0] += own[i].tolist()
                found[1] += own[j].tolist()
            else:
                for i in own[role[own] == 0].tolist():
                    for j in range(i + 1, int(ends[i])):
                        if one_edit(words[i], words[j]):
                            found[0].append(i)
                            found[1].append(j)
        out = {(words[i], words[j]): (int(n[i]), int(n[j])) for i, j in zip(*found, strict=True)}
        if out:
            a, b = zip(*out, strict=True)
            c, d = zip(*out.values(), strict=True)
            none = [None] * len(a)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip([[0] * len(a), none, none, a, c, b, d], kinds, strict=True)], names=names)

    def split(key: pa.Array, role: np.ndarray, word: pa.Array, n: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for i in rows.tolist():
            k, w = key[i].as_py(), word[i].as_py()
            left = {w} if role[i] else {w[:e] + w[e + 1 :] for e in range(len(w))}
            out += [(1, f"{k}.{x}", int(role[i]), w, int(n[i]), None, None) for x in left]
        for at in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 20_000], strict=True), kinds, strict=True)], names=names)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None  # rows of the list that may go on; the key of one that is split already
        for batch in batches:
            own = pa.Table.from_batches([batch]).combine_chunks()
            own = pa.concat_tables([held, own]).combine_chunks() if held is not None else own
            held = None
            if not own.num_rows:
                continue
            key, word = (own.column(i).combine_chunks() for i in (0, 2))
            role, n = (own.column(i).to_numpy() for i in (1, 3))
            change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
            starts = np.append(0, change)
            sizes = np.diff(np.append(starts, own.num_rows))
            away = np.zeros(len(starts), bool) if most is None else sizes > most
            away[0] |= key[0].as_py() == over
            if not away[-1]:
                held = own.slice(int(starts[-1]))
            over = key[int(starts[-1])].as_py() if away[-1] else None
            yield from split(key, role, word, n, np.flatnonzero(np.repeat(away, sizes)))
            whole = ~away
            whole[-1] = False
            rows = np.repeat(whole, sizes)
            if rows.any():
                mask = pa.array(rows)
                yield from pairs(key.filter(mask), role[rows], word.filter(mask), n[rows], np.cumsum(sizes[whole]) - sizes[whole], sizes[whole])
        if held is not None:
            key, word = (held.column(i).combine_chunks() for i in (0, 2))
            yield from pairs(key, held.column(1).to_numpy(), word, held.column(3).to_numpy(), np.zeros(1, np.int64), np.array([held.num_rows]))

    return sweep


def near_words(words: DataFrame, min_chars: int, staged: Staged, most: int = LIST, spread: int = SPREAD) -> DataFrame:
    """word, n, other, m: every word of ``words`` (word, n) with every other one edit away."""
    if min_chars < 4:
        raise ValueError("words of fewer than four letters have too few grams")
    shared = words.sparkSession.sparkContext.broadcast(frequent_grams(words, spread))
    listed = words.select("word", "n").mapInArrow(_listed(shared, min_chars), LISTED)
    swept = staged.put(listed.repartition("key").sortWithinPartitions("key", "role").mapInArrow(_swept(most), SWEPT), "lists")
    more = swept.filter("kind = 1").select("key", "role", "word", "n").repartition("key").sortWithinPartitions("key", "role").mapInArrow(_swept(None), SWEPT)
    pair = ["word", "n", "other", "m"]
    found = swept.filter("kind = 0").select(*pair).unionByName(more.select(*pair))
    return found.unionByName(found.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m"))).dropDuplicates(["word", "other"])


def followed(forms: DataFrame, largest: int, ratio: int, least: int, staged: Staged) -> DataFrame:
    """word and root: the end of each word's forms (word, form). Counts grow by ``ratio`` at each step, which bounds their number."""
    roots = forms.select("word", F.col("form").alias("root"))
    steps = max(1, math.floor(math.log(max(largest, least) / least, ratio)) + 1)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        on = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        roots = staged.put(roots.join(on, roots["root"] == on["_w"], "left").select("word", F.coalesce("_r", "root").alias("root")), "roots")
    return roots


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, ratio: int = RATIO, lost: int = LOST, most: int = LIST, spread: int = SPREAD) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of at least ``min_chars`` letters and ``min_count`` occurrences.

    Words are the maximal runs [A-Za-z\\u00C0-\\u00FF]+ of all texts, A-Z in lower case; a run of a document for which
    ``lost`` divides the CRC-32 h of ``<doc_id>:<run>`` loses letter h % length. A word's form is the near word (one edit away)
    with the largest n, ties going to the first in code-point order, if that is ``ratio`` times its own; its root is the
    last form that forms lead to.

    Null and empty texts have no words; a null doc_id is written as nothing; rows of one doc_id count each. A document of
    any length is read in slices. An empty table gives an empty result; further columns are not read. ``most`` and ``spread``
    say how lists are cut, not what comes out.
    """
    spark, staged = docs.sparkSession, Staged(docs.sparkSession, "variants")
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    counts = docs.select(doc.alias("d"), text_bytes().alias("t")).mapInArrow(_counts(lost, min_chars), "word string, n long")
    words = staged.put(counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "words")
    near = near_words(words, min_chars, staged, most, spread)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    form = -F.col("best.m") >= F.col("n") * ratio
    named = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best.form")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))
    named = staged.put(named, "forms")
    largest = named.agg(F.max("n")).first()[0] or 0
    roots = followed(named.filter("form is not null"), largest, ratio, min_count, staged)
    out = named.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    out = Staged(spark, "spellings").put(out, "words")
    staged.drop()
    return out


SQL = """
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
-- CRC-32: a byte is xored in, then eight steps (-1) shift a bit out
b AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(h) // 2), lambda i: [('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)) AS crc FROM c),
w AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, k FROM b),
v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
-- two words one edit apart: equal but for a letter at one place, or one is the other without a letter
d AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS cut FROM v, unnest(range(0, length(word))) AS u(i)),
e AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
f AS (SELECT word, count(*)::BIGINT AS n_near, min((-m, other)) AS best FROM e GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form, CASE WHEN -best[1] >= 5 * v.n THEN -best[1] END AS form_n FROM v LEFT JOIN f USING (word)),
t AS (WITH RECURSIVE q AS (SELECT word, word AS root, 0 AS depth FROM g UNION ALL SELECT q.word, g.form, depth + 1 FROM q JOIN g ON q.root = g.word WHERE g.form IS NOT NULL)
      SELECT word, arg_max(root, depth) AS root FROM q GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM g JOIN t USING (word)
"""
