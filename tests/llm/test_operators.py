"""Each operator on small tables with nulls, empty and long texts, ties and repeated rows, and against brute force."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ann, common, decontam, jaccard, lines, maskedlm, mixing, secret_levels, secrets, toxicity, urls, warc
from quillspark.llm.common import BLANKS, LETTERS, Lookup, hash_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, n_words string"
LONG = "kilo " * 30_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 5, "x", "y") for i, t, s in rows], DOCS)


ODD = [(1, None, "a"), (2, "", None), (3, "  \n\t ", "a"), (4, LONG, "b"), (5, "same text here", "a"), (5, "same text here", "a"), (6, "same text here", "b"), (None, "same text here", "c")]


def operators(spark):
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, "")], "item_id long, text string")
    model = {"bias": 0.0, "terms": np.zeros(0, np.uint32), "w": np.zeros(0), "v": np.zeros((0, toxicity.FACTORS))}
    return {
        "toxicity": lambda d: toxicity.score_toxicity(d, model), "lm": lambda d: maskedlm.score_documents(d, maskedlm.train(d)), "jaccard": lambda d: jaccard.jaccard_components(d, 4, 85),
        "mixing": mixing.mix_sources, "secrets": secrets.scan_secrets, "lines": lines.dedup_lines, "decontam": lambda d: decontam.find_contamination(d, bench),
    }


SAME = (5, 5, 6, None)
WANT = {
    "toxicity": ("score predicted", lambda i, t: (0.5, 1)),
    "lm": ("n_tokens", lambda i, t: (len((t or "").split()),)),
    "jaccard": ("n_shingles class_id component_id", lambda i, t: (int(i in (4, *SAME)), *(2 * (5 if i in SAME else i,)))),
    "mixing": ("size source_size", None),
    "secrets": ("base all", lambda i, t: ([], [])),
    "lines": ("text n_lines n_dropped", lambda i, t: (t or "", 1 + (t or "").count("\n"), 0)),
    "decontam": ("n_words n_hit items contaminated", lambda i, t: (len((t or "").split()), *((3, ["1"], True) if i in SAME else (0, [], False)))),
}


@pytest.mark.parametrize("name", list(WANT))
def test_odd_and_empty_tables(spark, name):
    apply, (columns, want) = operators(spark)[name], WANT[name]
    out = apply(docs(spark, ODD))
    assert apply(docs(spark, ODD).limit(0)).count() == 0
    if name != "jaccard":
        assert set(DOCS.replace(",", "").split()[::2]) <= set(out.columns) and len(out.columns) == len({c.lower() for c in out.columns})
    rows = out.collect()
    assert len(rows) == len(ODD)
    if name == "mixing":
        got = {(r.doc_id, r.source): r for r in rows}
        assert {(k, r["size"], r.source_size, r.target) for k, r in got.items() if k[1] != "b"} == {((1, "a"), 0, 6, 12.0), ((3, "a"), 0, 6, 12.0), ((5, "a"), 3, 6, 12.0), ((2, None), 0, 0, 0.0), ((None, "c"), 3, 3, 6.0)}
        assert got[5, "a"].taken == got[None, "c"].taken == 6 and all(r.taken <= 2 * r["size"] for r in rows) and got[4, "b"].target == 45000.0
        return
    key = lambda x: (x[0] is None, x[0] or 0)
    got = sorted([(r.doc_id, *(r[c] for c in columns.split())) for r in rows], key=key)
    assert got == sorted([(i, *want(i, t)) for i, t, _ in ODD], key=key)
    if name == "lm":
        assert all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in rows)
        assert max(same := [r.log_likelihood for r in rows if r.n_tokens == 3]) - min(same) < 1e-3


def test_toxicity_learns_words_and_their_beginnings(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        rows.append((i, " ".join(rng.choices(words, k=30)) + (f" vilest{rng.choice('abcd')} awful" if toxic else ""), "a"))
        labels.append((i, int(toxic)))
    d = docs(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, toxicity.train(d, known.filter(~toxicity.fold()))).collect()}
    assert sum(out[i] == y for i, y in labels) >= 590


def test_machine_is_a_sum_over_pairs():
    rng = np.random.default_rng(0)
    w, v, own = rng.normal(size=9), rng.normal(size=(9, 4)), np.array([1, 4, 8])
    pairs = sum(v[a] @ v[b] for a, b in ((1, 4), (1, 8), (4, 8)))
    assert abs(toxicity.machine_output(0.5, w, v, own) - (0.5 + w[own].sum() + pairs)) < 1e-12


@pytest.mark.parametrize("both", [False, True])
def test_toxicity_learns_pairs_that_are_harmless_alone(spark, both):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(200)}" for _ in range(30)] + ["insult"] * one + ["people"] * two
        rng.shuffle(words)
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int((one and two) if both else (one == two))))
    d, known = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(d, toxicity.train(d, known.filter(~toxicity.fold()))).filter(toxicity.fold()).collect()}
    assert len(out) > 150 and sum(out[i] == dict(labels)[i] for i in out) >= 0.95 * len(out)


def test_toxicity_sample_is_bounded_by_ids(spark):
    d = docs(spark, [(i % 7, f"word{i}", "a") for i in range(100)])
    seen = []
    spark_rows = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, toxic int")
    model = toxicity.train(d, spark_rows, most=5)
    seen.append(len(model["terms"]))
    assert seen == [0]  # five ids, a row each: no term occurs twice


def numbered(known, text):
    """Tokens and shares of a text's words."""
    h, _, tails = hash_words(pa.array([text.encode()], pa.binary()), maskedlm.WORDS, True)
    return maskedlm.Numbers(known.plain())(h, tails)


def test_lm_scores_against_plain_sums(spark):
    d = docs(spark, [(i, "the cat sat on the mat " * (i + 1), "a") for i in range(20)] + [(99, None, "a")])
    known, weights = maskedlm.train(d)
    p = maskedlm.shaped(np.frombuffer(weights, np.float32))
    got = {r["doc_id"]: r for r in maskedlm.score_documents(d, (known, weights)).collect()}
    assert (got[99]["n_tokens"], got[99]["log_likelihood"], got[99]["mean_log_prob"]) == (0, 0.0, None)
    t = [0, 0, *numbered(known, "The cat sat, on THE mat!")[0].tolist(), 0, 0]
    total = 0.0
    for i in range(2, len(t) - 2):
        h = np.append(np.tanh(sum(p["e"][k][t[i + o]] for k, o in enumerate((-2, -1, 1, 2)))), 1.0)
        group, inside = h @ p["c"], h @ p["w"][t[i] % maskedlm.GROUPS]
        total += np.log(np.exp(group) / np.exp(group).sum())[t[i] % maskedlm.GROUPS] + np.log(np.exp(inside) / np.exp(inside).sum())[t[i] // maskedlm.GROUPS]
    assert abs(got[0]["log_likelihood"] - total) < 1e-3


def test_lm_steps_follow_the_gradient():
    rng = np.random.default_rng(2)
    p = maskedlm.start()
    context, target = rng.integers(1, 40, (4, 300)), rng.integers(1, 40, 300)
    before = maskedlm.log_probabilities(p, context, target).mean()
    squares = {k: np.full(v, 1e-3, np.float32) for k, v in maskedlm.shapes().items()}
    for _ in range(30):
        maskedlm.learn(p, squares, context, target)
    assert maskedlm.log_probabilities(p, context, target).mean() > before + 3


def test_lm_trains_on_every_position_once(monkeypatch):
    seen = []
    monkeypatch.setattr(maskedlm, "learn", lambda p, squares, context, target: seen.extend(target.tolist()))
    tokens = np.concatenate([np.r_[0, 0, np.tile(np.arange(1, 9), k + 1)] for k in range(40)] + [[0, 0]]).astype(np.uint16)
    batch = pa.RecordBatch.from_arrays([pa.array([tokens.tobytes()], pa.binary())], names=["tokens"])
    weights = SimpleNamespace(value=maskedlm._flat(maskedlm.start()).astype(np.float32).tobytes())
    for rounds in (maskedlm.ROUNDS, 5):
        seen.clear()
        for r in range(rounds):
            before = len(seen)
            out = list(maskedlm._train(weights, r, rounds)(iter([batch])))
            assert out[0].column("steps")[0].as_py() == 1 and len(seen) > before
        assert np.bincount(seen, minlength=9).tolist() == [0] + [sum(range(1, 41))] * 8


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(maskedlm, "SHARD", 2000)
    rng = random.Random(8)
    d = docs(spark, [(i, " ".join(f"v{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randint(0, 80))), "a") for i in range(300)])
    weights, scores = [], []
    for n in (2, 8):
        model = maskedlm.train(d.repartition(n))
        weights.append(model[1])
        scores.append({r["doc_id"]: r["log_likelihood"] for r in maskedlm.score_documents(d.repartition(n), model, ["doc_id"]).collect()})
    assert weights[0] == weights[1] and weights[0] != maskedlm._flat(maskedlm.start()).tobytes()
    assert max(abs(scores[0][i] - scores[1][i]) for i in range(300)) < 1e-3


@pytest.mark.parametrize("held", [1 << 16, maskedlm.KNOWN + 1])
def test_lm_rare_words_have_their_own_shares(spark, monkeypatch, held):
    monkeypatch.setattr(maskedlm, "HELD", held)
    common = " ".join(f"c{i}" for i in range(maskedlm.KNOWN))
    often, once, new = "oftenxyz", "oncexyz", "newxyz"  # the same last letters
    model = maskedlm.train(docs(spark, [(i, f"{common} {common} {often}", "a") for i in range(4)] + [(9, f"{common} {once}", "a")]))
    got = {r["doc_id"]: r for r in maskedlm.score_documents(docs(spark, [(1, often, "a"), (2, once, "a"), (3, new, "a"), (4, "c1", "a"), (5, f"{often} {often}", "a")]), model).collect()}
    assert abs(got[1]["log_likelihood"] - got[2]["log_likelihood"] - np.log(4)) < 1e-5
    assert abs(got[2]["log_likelihood"] - got[3]["log_likelihood"] - np.log(3)) < 1e-5
    p = maskedlm.shaped(np.frombuffer(model[1], np.float32))
    for i, text, share in ((1, often, np.log(4 / 6)), (4, "c1", 0), (5, f"{often} {often}", 2 * np.log(4 / 6))):
        tokens = numbered(model[0], text)[0]
        assert abs(got[i]["log_likelihood"] - maskedlm.token_scores(p, tokens, np.array([len(tokens)])).sum() - share) < 1e-4
        assert abs(got[i]["mean_log_prob"] * got[i]["n_tokens"] - got[i]["log_likelihood"]) < 1e-9


def test_words_are_hashed_alike_wherever_they_stand():
    rng = random.Random(1)
    rows = [bytes(rng.choice(b"aB c\td\xc3\xa9 _1\x00") for _ in range(rng.randint(0, 12))) for _ in range(500)] + [b"", b" ", b"q" * 3000 + b" " + b"q" * 3001, b"xab xyab"]
    column, seen = pa.array(rows, pa.binary()), {}
    for part, own in ((column, rows), (column.slice(7, 100), rows[7:107]), (column.slice(0, 0), []), (column.slice(500, 2), rows[500:502])):
        for fold, split in ((BLANKS, lambda x: x.lower().split()), (LETTERS, lambda x: re.findall(rb"[0-9a-z\x80-\xff]+", x.lower()))):
            hashes, sizes, tails = hash_words(part, fold, True)
            want = [split(x) for x in own]
            assert sizes.tolist() == [len(x) for x in want]
            for word, h, tail in zip([w for x in want for w in x], hashes.tolist(), tails.tolist(), strict=True):
                assert seen.setdefault(word, h) == h and seen.setdefault(h, word) == word and seen.setdefault(("tail", word[-3:]), tail) == tail
    known = np.unique(np.array([h for h in seen if isinstance(h, int)], np.uint64))
    assert Lookup(known[::2])(known).tolist() == [i // 2 if i % 2 == 0 else -1 for i in range(len(known))]


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, width, percent):
    rng = random.Random(width)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(60)]
    rows = []
    for g in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 8, 12, 20, 40, 120]))
        for _ in range(rng.randint(1, 25)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows), " ".join(own), "a"))
    rows.append((len(rows), "", "a"))
    sets = {}
    for i, t, _ in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in range(a):
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows), width, percent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_subsets_of_linked_small_sets_meet():
    rng = random.Random(4)
    for _ in range(200):
        a = set(rng.sample(range(40), rng.randint(1, 14)))
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, 1)))) | ({99} if rng.random() < 0.5 else set())
        k = len(a & b)
        if 100 * k >= 85 * (len(a) + len(b) - k):
            counts = np.zeros(1 << jaccard.SKETCH_BITS, np.uint32)
            keys = [set(jaccard.keys_of(np.array(sorted(s), np.uint64), counts, 20, 85)[0].tolist()) for s in (a, b)]
            assert keys[0] & keys[1]


@pytest.mark.parametrize("size", [1, 2, 5, 10_000])
def test_linked_sets_stay_in_a_common_list(size):
    rng = random.Random(size)
    sets = []
    for _ in range(30):
        base = rng.sample(range(400), rng.randint(2, 60))
        sets += [np.array(sorted({x if rng.random() < 0.97 else rng.randrange(400) for x in base}), np.uint64) << np.uint64(50) for _ in range(rng.randint(1, 6))]
    counts = np.zeros(1 << jaccard.SKETCH_BITS, np.uint32)
    for x in sets:
        counts[(x >> np.uint64(64 - jaccard.SKETCH_BITS)).astype(np.int64)] += 1
    rows = []
    for i, x in enumerate(sets):
        keys, places = jaccard.keys_of(x, counts, 8, 85)
        rows += [(k, len(x), bool(p >= jaccard.early(len(x), 85)), i, p) for k, p in zip(keys.astype(np.int64).tolist(), places.tolist(), strict=True)]
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[r[j] for r in rows[k : k + size]] for j in (0, 3, 1, 4, 2)], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["key", "fp", "n", "place", "late"]) for k in range(0, len(rows), size)]
    lists, stars = {}, set()
    for b in jaccard._stars(85)(iter(batches)):
        for kind, a, fp in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
            if kind:
                lists.setdefault(a, set()).add(fp)
            else:
                stars.add((a, fp))
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert len(linked) > 30 and stars
    assert all(any({i, j} <= own for own in lists.values()) for i, j in linked)


def test_jaccard_long_lists_in_cells(spark, monkeypatch):
    """Sets that share a long passage and differ else, among them near copies: with cells of a few entries as with one cell."""
    monkeypatch.setattr(jaccard, "LIST_PART", 5)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for g in range(12):
        own = " ".join(f"g{g}x{rng.randrange(1000)}" for _ in range(25))
        rows += [(len(rows) + k, f"{passage} {own}" + (" end" if k else ""), "a") for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs(spark, rows), 4, 85).collect()}
    assert got == {i: i - i % 3 for i in range(36)}


@pytest.mark.parametrize("first, later", [(40, 40), (0, 30), (30, 0)])
def test_components_with_further_links(spark, first, later):
    rng = random.Random(first)
    links = [(rng.randrange(100), rng.randrange(100)) for _ in range(first + later)]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    roots = jaccard.components(frame(links[:first]))
    got = {r["node"]: r["root"] for r in jaccard.joined(roots, frame(links[first:]), jaccard.Staged(spark, "test")).collect()}
    want = {x: x for pair in links for x in pair}
    for _ in links:
        for x, y in links:
            want[x] = want[y] = min(want[x], want[y])
    assert {x: got.get(x, x) for x in want} == want


def test_jaccard_rows_of_one_id_keep_their_own_links(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(7, one, "a"), (7, two, "a"), (8, f"{one} x", "a"), (9, f"{two} x", "a"), (None, f"{two} y", "a"), (None, "quite alone here it stands", "a")]
    got = Counter((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(docs(spark, rows), 4, 85).collect())
    assert got == Counter([(7, 7), (7, 7), (8, 7), (9, 7), (None, 7), (None, None)])


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)]
    out = mixing.mix_ids(docs(spark, rows)).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_ids(docs(spark, rows[::-1])).collect()}
    assert {r["doc_id"]: r["taken"] for r in out} == again
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    taken, target = Counter(), {}
    by = {i: s for i, _, s in rows}
    for r in out:
        taken[by[r["doc_id"]]] += r["taken"]
        target[by[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in out)) < 1e-6


def test_secret_spans_and_battery(spark):
    rng = random.Random(5)
    blob = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60))
    hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    text = f'é Password = "hunter22" token: abc AKIA{"A1B2" * 5} {hexes} {blob} {"abcabcabc1" * 6}'
    d = docs(spark, [(1, text, "a"), (2, "secret: token : abcdefgh", "a")])
    out = {r["doc_id"]: r for r in secrets.scan_secrets(d).select("doc_id", secrets.listed("base").alias("b"), secrets.listed("all").alias("s")).collect()}
    spans = []
    for kind, found in (("assign", [m for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6]), ("access", list(re.finditer(secrets.ACCESS, text))), ("hex", [m for m in re.finditer(secrets.HEX, text) if len(m[0]) >= 24])):
        spans += [(m.start(), secrets.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in found]
    assert out[1]["b"] == ",".join(s[2] for s in sorted(spans)) and out[2]["b"] == ""
    at = text.index(blob)
    assert f"random:{at}:{at + 60}" in out[1]["s"].split(",") and out[1]["s"].count("random") == 1


def test_random_tokens_are_found_whatever_surrounds_them(spark):
    rng = random.Random(4)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    mixed, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    hidden = [pick(letters, n) for letters, n in ((mixed, 20), (mixed, 22), (mixed, 30), (lower, 64), (lower.upper(), 64)) for _ in range(20)]
    rows = [(i, f"see {t} there", "a") for i, t in enumerate(hidden)]
    plain = [(1000 + i, "/".join(rng.choices(("reports", "archive", "station", "garden", "winter"), k=4)), "a") for i in range(300)]
    plain += [(2000 + i, "".join(rng.choices(("reports", "archive", "station", "garden", "winter"), k=4)), "a") for i in range(300)]
    found = []
    for more in ([], plain):
        out = {r["doc_id"]: r["s"] for r in secrets.scan_secrets(docs(spark, rows + more)).select("doc_id", secrets.listed("all").alias("s")).collect()}
        found.append({i for i in range(len(rows)) if "random" in out[i]})
        assert sum("random" in s for i, s in out.items() if i >= 1000) <= 0.05 * len(more)
    assert found[0] == found[1]
    assert [len([i for i in found[0] if i // 20 == k]) >= 10 for k in range(5)] == [True] * 5


@pytest.mark.parametrize("at_once", [8 << 20, 0])
def test_marks_take_few_jobs_whatever_the_partitions(spark, monkeypatch, at_once):
    frame, numbers = type(spark.range(0)), spark.range(0, 3000, 3)
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: deal(self, max(n, 211), *by))
    monkeypatch.setattr(common, "MARK_AT_ONCE", at_once)
    spark.sparkContext.setJobGroup(f"marks{at_once}", "marks")
    bitmap, bits = common.marks(numbers)
    spark.sparkContext.setJobGroup("others", "others")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"marks{at_once}")) <= 30
    likely = common.may_be_marked(pa.array(range(3000)), bitmap, bits).to_pylist()
    assert all(likely[::3]) and sum(likely) < 1500


def test_few_of_the_reported_tokens_are_words_however_many_there_are(spark):
    rng = random.Random(9)
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    nulls = secret_levels.null_strings(texts, 64).cache()
    words = [r["token"] for r in nulls.filter("range = 32 and not single").limit(3000).collect()]
    hidden = ["".join(rng.choices(string.ascii_letters + string.digits, k=32)) for _ in range(150)]
    rows = [(i, f"see {t} there", "a") for i, t in enumerate(hidden + words)]
    out = {r["doc_id"]: r["s"] for r in secrets.scan_secrets(docs(spark, rows)).select("doc_id", secrets.listed("all").alias("s")).collect()}
    true, false = (sum("random" in out[i] for i in of) for of in (range(150), range(150, len(rows))))
    assert len(words) > 2000 and true >= 60 and false <= 0.15 * (true + false)
    # the table of levels holds for other words than it was fitted on
    scored = secrets.with_chances(secrets.battery(nulls.filter("range in (20, 32, 64)").drop("range")))
    shares = scored.groupBy("range", "single").agg(*[F.avg((F.col("p") <= t).cast("double")).alias(str(i)) for i, t in enumerate((0.05, 0.01))]).collect()
    assert len(shares) == 6 and all(r["0"] <= 0.075 and r["1"] <= 0.02 for r in shares)


def test_step_up_rule_against_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(f"t{i}", rng.choice(["lower", "base62"]), rng.choice([20, 32]), rng.choice([1.0] * 6 + list(secrets.TAILS))) for i in range(160)]
    rows += [("one", "hex_upper", 20, 0.02), ("none", "decimal", 20, 0.05)] + [("often", "decimal", 64, 0.05)] * 50
    want = set()
    for family in {r[1:3] for r in rows}:
        own = {r[0]: r[3] for r in rows if r[1:3] == family}
        w = (1 + sum(p > 0.05 for p in own.values())) / 0.95
        best = max((t for t in secrets.TAILS if (r := sum(p <= t for p in own.values())) and t in own.values() and w * t <= 0.05 * r), default=0)
        want |= {t for t, p in own.items() if p <= best}
    got = {r["token"] for r in secrets.discoveries(spark.createDataFrame(rows, "token string, encoding string, range int, p double")).collect()}
    assert got == want and "one" in got and "often" not in got and 0 < len(got) < 160


def test_lines_against_plain_counts(spark):
    rng = random.Random(6)
    pool = [f"Line number {i} of the common pool" for i in range(30)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(pool).upper() for _ in range(rng.randint(0, 8))), "a") for i in range(60)]
    holders = {}
    for i, t, _ in rows:
        for x in t.split("\n"):
            if len(x.strip()) >= 20:
                holders.setdefault(x.strip().lower(), set()).add(i)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        keep = [x for x in t.split("\n") if len(h := holders.get(x.strip().lower(), set())) < 3 or max(h) == i]
        assert got[i] == "\n".join(keep)


@pytest.mark.parametrize("how", [{"pass_bits": 1 << 13}, {"held_keys": 0}, {"held_keys": 3, "pass_bits": 1 << 13}])
def test_lines_in_passes_and_with_few_held_keys(spark, how):
    rng = random.Random(6)
    pool = [f"Line number {i} of the common pool" for i in range(30)] + ["short", ""]
    rows = [(i if i != 9 else None, "\n".join(rng.choice(pool).upper() for _ in range(rng.randint(0, 8))), "a") for i in range(60)]
    got = [sorted((r["doc_id"] or -1, r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(docs(spark, rows), **k).collect()) for k in ({}, how)]
    assert got[0] == got[1] and sum(r[3] for r in got[0]) > 100


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"w{i}" for i in range(12)]
    items = [(i if i != 5 else None, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(25)] + [(7, "W1, w2! w3"), (30, None), (31, "..."), (None, "w9")]
    texts = {i: (rng.choice(["", "é "]) + "; ".join(rng.choices([*pool, "zz", "W3"], k=rng.randint(0, 40)))) if i % 7 else f"{rng.choice(items)[1]} zz {rng.choice(items)[1]}".upper() for i in range(120)}
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = [(i, w[k : k + 10]) for i, x in items for w in [fold(x)] for k in range(max(1, len(w) - 9) if w else 0)]
    d, bench = docs(spark, [(i, t, "a") for i, t in texts.items()]), spark.createDataFrame(items, "item_id long, text string")
    for most in (100_000, 3):
        for r in decontam.find_contamination(d, bench, most=most).collect():
            w, hit, found = fold(texts[r["doc_id"]]), set(), set()
            for i, win in wins:
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        found.add(None if i is None else str(i))
            assert (r["n_words"], r["n_hit"], r["contaminated"], set(r["items"])) == (len(w), len(hit), bool(hit), found)
            cut = [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]]
            assert [x for c in cut for x in fold(c)] == [w[k] for k in sorted(hit)]
            assert all(fold(c[0]) and fold(c[-1]) for c in cut)  # spans begin and end on words


def test_decontamination_spans_and_blocks(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"
    d = docs(spark, [(1, "é… ALPHA Beta gamma delta epsilon zeta eta theta iota kappa lambda x", "a"), (2, "short one here", "a"), (3, "alpha beta gamma", "a")])
    bench = spark.createDataFrame([(7, item), (8, "one here")], "item_id long, text string")
    for most in (100, 1):
        out = {r["doc_id"]: r for r in decontam.find_contamination(d, bench, most=most).collect()}
        assert (out[1]["n_hit"], out[1]["items"], out[2]["n_hit"], out[2]["items"], out[3]["contaminated"]) == (11, ["7"], 2, ["8"], False)
        s = out[1]["spans"][0]
        assert "é… ALPHA Beta gamma delta epsilon zeta eta theta iota kappa lambda x"[s["start"] : s["end"]] == "ALPHA Beta gamma delta epsilon zeta eta theta iota kappa lambda"


def test_urls_odd_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://X.COM/en/1?q"), (4, "http://a.example.com/en/71"), (5, "http://notcom/en/"), (6, "http://com#/en/"), (6, "http://com#/en/"), (7, "http://com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect() if r["rule"])
    assert got == [(3, "com/en/", "block"), (4, "example.com/en/7", "allow"), (7, "com/en/", "block")]
    assert urls.filter_urls(pages, rules).count() == 8 and urls.filter_urls(pages.limit(0), rules).count() == 0


def test_urls_keep_columns_of_any_name_and_type(spark):
    long = "http://x.com/en/" + "a" * 100_000
    rows = [(1, long, {"a": 1}, "k", 2, "p", [1], "h"), (2, "http://y.org/", None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, Kind map<string,int>, key string, range int, Path string, dealt array<int>, html_ string")
    out = urls.filter_urls(pages, spark.createDataFrame(urls.RULES, "host string, path string, verdict string"))
    assert out.columns == ["page_id", "url", "Kind", "key", "range", "dealt", "html_", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: r for r in out.collect()}
    assert (got[1]["url"], got[1]["Kind"], got[1]["key"], got[1]["dealt"], got[1]["rule"], got[1]["verdict"]) == (long, {"a": 1}, "k", [1], "com/en/", "block")
    assert (got[2]["Kind"], got[2]["host"], got[2]["rule"]) == (None, "y.org", None)


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [1.0]), (100, x[100].tolist())]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in ann.nearest_neighbours(store, store.filter("vec_id % 100 = 0")).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        own = sorted(out[q])
        assert [o[0] for o in own] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in own)
        hit += len({o[1] for o in own} & set(want.tolist()))
    assert hit >= 0.9 * 300 and [o[1] for o in sorted(out[100])] == list(range(101, 111))
    assert ann.nearest_neighbours(store.limit(0), store.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_ties_clashing_columns_and_dimensions(spark, kind):
    """Small whole numbers give many equal distances, over several batches and dimensions; with few rows all are met."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(1, 3, 3 if i % 2 else 5).astype(float).tolist(), i, "x") for i in range(90)] + [(7000, [9.0, 9.0], 0, "x")]
    store = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, rank int, score string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = ann.nearest_neighbours(store, store.filter("vec_id % 30 = 0 or vec_id = 7")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in (0, 7, 30, 60):
        x = np.array(rows[q][1])
        near = sorted((float(np.sqrt(((np.array(r[1]) - x) ** 2).sum())), r[0]) for r in rows if r[0] != q and len(r[1]) == len(x))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["score"], r["vec_id"]) for r in own] == near
    assert not [r for r in got if r["query_id"] == 7000]


def test_nearest_rows_keep_all_that_tie():
    q, c = np.array([[1, 1]] * 5 + [[1, 2]] * 2), np.array([[0, 1], [0, 2], [0, 2], [0, 3], [0, 4], [0, 5], [0, 6]])
    score = np.array([np.sqrt(3), np.sqrt(3), np.sqrt(3), 1.0, 2.0, 5.0, 4.0])
    assert sorted(ann.nearest_rows(q, c, score, 2).tolist()) in ([0, 1, 3, 5, 6], [0, 2, 3, 5, 6])


def plain_record(page_id, url, html, refers_to):
    """The record that the archive must give back, written without Spark."""
    body = (html or "").encode()
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {warc.DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}"]
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {warc.PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {0 if refers_to is not None else len(body)}"]
    return "\r\n".join([*lines, "", ""]).encode() + (b"" if refers_to is not None else body) + b"\r\n\r\n"


def test_archive_gives_back_the_written_bytes(spark, tmp_path):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://d\r\n", ""), (5, "http://e", "x" * 200_000), (None, "http://n", "only here"), (None, "http://m", "<p>é</p>"), (6, "u", "own one"), (6, "v", "own two"), (6, "w", "own two")]
    refers = [2, None, 4, None, None, None, 2, None, None, None]
    pages = spark.createDataFrame([(*r, "clash", b"z") for r in rows], "page_id long, url string, html string, digest string, payload binary")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = sorted(bytes(r["record"]) for r in warc.warc_records(spark, str(tmp_path / "w")).collect())
    assert got == sorted(plain_record(*r, to) for r, to in zip(rows, refers, strict=True))
    out = warc.read_archive(spark, str(tmp_path / "w")).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, len((h or "").encode()), "response" if to is None else "revisit", to, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for (i, _, h), to in zip(rows, refers, strict=True)]
    assert sorted([(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in out], key=key) == sorted(want, key=key)
    assert all(r["verified"] for r in out)
    warc.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_a_changed_payload_is_noticed(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "one"), (2, "v", "one"), (3, "w", "two")], "page_id long, url string, html string"), str(tmp_path / "w"))
    rows = spark.read.parquet(str(tmp_path / "w" / "payloads")).collect()
    spoiled = [(bytes(r["digest"]), zlib.compress(b"spoiled") if zlib.decompress(r["payload"]) == b"one" else bytes(r["payload"])) for r in rows]
    spark.createDataFrame(spoiled, "digest binary, payload binary").write.mode("overwrite").parquet(str(tmp_path / "w" / "payloads"))
    assert {r["page_id"]: r["verified"] for r in warc.read_archive(spark, str(tmp_path / "w")).collect()} == {1: False, 2: False, 3: True}
