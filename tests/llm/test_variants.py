"""Spelling variants against brute force: the gram bound, list merging, split lists, odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import variants

SCHEMA = "doc_id long, text string, word string, n int"


def edits(word, letters):
    return {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in (*letters, "")} | {word[:i] + x + word[i:] for i in range(len(word) + 1) for x in letters} - {word}


def plain(rows, lost=199, min_chars=6, min_count=5, ratio=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % lost == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= min_chars and k >= min_count}
    near = {w: [x for x in n if variants.one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= ratio * n[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def got(spark, rows, **options):
    out = variants.spelling_variants(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), **options)
    return sorted((tuple(r) for r in out.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def made(seed, words, docs):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(5, 11))) for _ in range(words)]
    rows = []
    for i in range(docs):
        own = [rng.choice(base[: 1 + int(words * rng.random() ** 4)]) for _ in range(60)]
        own = [w if rng.random() > 0.1 else rng.choice(sorted(edits(w, "abé"))) for w in own]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return rows


ODD = [(None, "Straße straße strasse1straße " * 3), (None, None), (1, ""), (2, "a" * 30_000 + " aaaaaaa" * 9), (2, "aaaaaa " * 50), (3, "naïve×÷ÿ naïve×÷ÿ," * 5), (3, "中文abcdefgh中" * 6), (4, "x" * 80 + " " + "y" * 80), (5, ("z" * 60 + " ") * 5 + ("z" * 61 + " ") * 30)]


@pytest.mark.parametrize("options", [{}, {"lost": 3}, {"most": 3}, {"spread": 10}, {"spread": 10, "most": 5, "lost": 7}, {"min_chars": 4}])
def test_equals_brute_force(spark, options):
    rows = made(len(options), 150, 150) + ODD
    want = plain(rows, **{k: v for k, v in options.items() if k in ("lost", "min_chars")})
    assert sum(r[1] is not None for r in want) > 10
    assert got(spark, rows, **options) == want


def test_chains_of_forms(spark):
    words = {"abcdefgh": 5, "abcdefghi": 25, "abcdefghij": 125, "abcdefghijk": 625, "abcdefghijkl": 3125, "abcdefxh": 25}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    assert got(spark, rows, lost=10**9) == plain(rows, lost=10**9)
    assert {r[2] for r in plain(rows, lost=10**9)} == {"abcdefghijkl", "abcdefxh"}


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, "")]) == []
    with pytest.raises(ValueError):
        got(spark, [(1, "abcde " * 9)], min_chars=3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=30), st.text("abc", min_size=6, max_size=12), st.data())
def test_words_one_edit_apart_share_a_rare_gram_at_the_next_place(grams, word, data):
    frequent = {g: 1 + zlib.crc32(g.encode()) % 9 for g in grams}
    other = data.draw(st.sampled_from(sorted(x for x in edits(word, "abcd") if len(x) >= 6)))
    short, long = sorted((word, other), key=len)
    k = variants.longest_gram(len(long), 6)
    ours, theirs = ({(g, p) for _, g, p in variants.rare_grams(w, k, frequent)} for w in (short, long))
    assert theirs & (ours if len(short) == len(long) else {(g, q) for g, p in ours for q in (p, p + 1)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", min_size=3, max_size=5), min_size=1, max_size=12))
def test_comparison_of_lists(words):
    words = sorted({w.ljust(4, "a")[:4] for w in words}) + sorted({w[:3] for w in words})
    role = np.array([int(len(w) == 3) for w in words])
    i, j = variants.near_pairs(words, role, np.full(len(words), len(words)))
    want = {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if not role[a] and variants.one_edit(words[a], words[b])}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_one_edit():
    assert all(variants.one_edit("abcd", x) for x in edits("abcd", "ax") - {"abcd"})
    assert not any(variants.one_edit(*x) for x in (("abcd", "abcd"), ("abcd", "abdc"), ("abcd", "ab"), ("abcd", "xbcx"), ("abcd", "bcde")))
