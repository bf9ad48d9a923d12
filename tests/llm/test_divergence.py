"""Distances between sources against brute force: odd rows, ties, spilled runs, tiles, and the heap."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quillspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank string, item int"


def plain(rows, min_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda own: {t: 1 + 10**9 * (own[t] + 5) // (sum(own[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        every = sum((counts[g] for g in groups if g[0] == lang), Counter())
        p = {s: share(counts[lang, s]) for x, s in groups if x == lang}
        q = share(every)
        for s in p:
            found = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


def made(seed, n, sources):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "éa", "x" * 5000, "中文"]
    rows = [(i, " ".join(rng.choices(words, [1 / (k + 1 + i % 3) for k in range(len(words))], k=rng.randrange(30))), rng.choice(["en", "de", None]), rng.choice(sources)) for i in range(n)]
    odd = [(1, None, "en", None), (1, "", "xx", "only"), (None, "Wa waa 1wa", "en", "s1"), (2, "wab " * 3000, "en", "s1"), (2, "wab " * 3000, "en", "s1"), (3, "§ 1 \x00", "yy", "a"), (4, "", "yy", "b"), (5, None, None, None)]
    return rows + odd


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "r", 1) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.source_divergence(table, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def test_equals_brute_force(spark):
    rows = made(1, 400, ["s1", "s2", "S3", "é", None])
    assert got(spark, rows, min_docs=5, top=7) == plain(rows, 5, 7)
    assert got(spark, rows, min_docs=5, top=7, run_postings=20) == plain(rows, 5, 7)
    assert got(spark, rows, min_docs=10**6) == plain(rows, 10**6, 50)


def test_tiles_and_long_texts_in_slices(spark, monkeypatch):
    for name, value in {"TILE": 4, "TERMS": 5, "CHUNK": 3, "SLICE": 64, "WINDOW": 7}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = made(2, 500, [f"s{i}" for i in range(19)])
    assert got(spark, rows, min_docs=2, top=3, run_bytes=2000) == plain(rows, 2, 3)


def test_no_rows(spark):
    assert got(spark, []) == []


@pytest.mark.parametrize("runs", [0, 1, 7])
def test_heap_opens_chunks_as_they_are_reached(runs):
    rng = random.Random(runs)
    entries = [sorted((f"{rng.randrange(50):02}", rng.randrange(9)) for _ in range(40)) for _ in range(runs)]
    chunks, opened = sorted(run[at : at + 4] for run in entries for at in range(0, 40, 4)), []

    def lazily():
        for own in chunks:
            opened.append(own[0][0])
            yield pa.array([x for x, _ in own]), pa.array([x for _, x in own])

    out, seen = [], set()
    for parts in divergence.heap_merged(lazily(), 20):
        own = [(x, y) for p in parts for x, y in zip(p[0].to_pylist(), p[1].to_pylist(), strict=True)]
        assert not seen & {x for x, _ in own} and (len(opened) == len(chunks) or len(opened) - len(out) // 4 < 30)
        seen |= {x for x, _ in own}
        out += own
    assert sorted(out) == sorted(x for run in entries for x in run)


def test_slices_end_between_terms():
    text = ("abc é " * 50 + "x" * 400 + " end").encode()
    parts = list(divergence.slices(text, 37))
    assert b"".join(parts) == text and len(parts) > 5
    assert [t for p in parts for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)
