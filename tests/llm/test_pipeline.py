"""The pipeline, stage by stage and as a whole, against a plain version on a small corpus."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quillspark.llm import toxicity
from quillspark.llm.common import stage, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean texts, toxic ones, near copies, a shared line, benchmark passages, and null and empty texts."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8))) for _ in range(1500)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    items, texts = [text(25) for _ in range(6)], []
    for i in range(400):
        own = text(rng.randint(8, 90))
        if i % 8 == 1:
            own += " vilest scum" + " utterly vilest" * (i % 3)
        elif i % 8 == 3:
            own += "\nThis line stands in very many of the documents here\n" + text(6)
        elif i % 8 == 5 and i % 16 == 5:
            own += " " + " ".join(items[i % 6].upper().split()[3:18]) + ", " + text(3)
        texts.append(own)
    for i in range(0, 200, 8):  # near and exact copies of clean texts
        own = texts[i].split()
        own[-1] = rng.choice(words)
        texts += [texts[i], " ".join(own)]
    texts += [None, "", "   \n "]
    rows = [(i, t, "en", rng.choice(["x", "x", "x", "y", None]), len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(bool(texts[i]) and "vilest" in texts[i])) for i in range(350)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r for r in rows}, items


def plain_toxic(spark, path, rows):
    model = toxicity.train(table(spark, path, "documents").select("doc_id", "text"), table(spark, path, "labels").filter(~toxicity.fold()))
    place = {int(t): i for i, t in enumerate(model["terms"])}
    kept = {}
    for i, r in rows.items():
        own = [place[t] for t in toxicity.terms((r[1] or "").encode()).tolist() if t in place]
        z = model["bias"] + sum(model["w"][a] for a in own) + sum(float(model["v"][a] @ model["v"][b]) for k, a in enumerate(own) for b in own[:k])
        if 1 / (1 + np.exp(-z)) < 0.5:
            kept[i] = r
    return kept


def key(line):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))


def plain_lines(rows):
    holders = defaultdict(set)
    for i, r in rows.items():
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, r in rows.items():
        text = "\n".join(x for x in (r[1] or "").split("\n") if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i)
        out[i] = (*r[:1], text, *r[2:4], len(text))
    return out


def plain_copies(rows, width=5, percent=80):
    sets, root = {}, {i: i for i in rows}
    for i, r in rows.items():
        w = key(r[1] or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b]) if b < a else 0
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: r for i, r in rows.items() if find(i) == i}


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", key(text or ""))


def plain_leaks(rows, items):
    wins = {tuple(w[k : k + 10]) for w in map(fold, items) for k in range(max(1, len(w) - 9))}
    return {i: r for i, r in rows.items() if not any(tuple(w[k : k + 10]) in wins for w in [fold(r[1])] for k in range(max(1, len(w) - 9)))}


def plain_mix(rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for i, r in rows.items()}
    sources = sorted({r[3] for r in rows.values()}, key=lambda s: (s is None, s or ""))
    own = {s: [i for i in rows if rows[i][3] == s] for s in sources}
    total = {s: sum(size[i] for i in own[s]) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2.0 * total[s] if full else share[s]
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    out = {}
    for s in sources:
        base = int(target[s] // total[s])
        rest, taken, more = target[s] - base * total[s], 0, set()
        for i in sorted(own[s], key=lambda i: hashlib.md5(str(i).encode()).hexdigest()[:10]):
            if abs(taken + size[i] - rest) >= abs(taken - rest) and size[i]:
                break
            taken += size[i]
            more.add(i)
        out |= {i: (size[i], total[s], round(target[s], 6), size[i] * (base + (i in more))) for i in own[s]}
    return out


def by_id(df):
    return {r[0]: tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()}


def test_every_stage_and_the_whole_against_plain_versions(spark, corpus):
    path, rows, items = corpus
    plain = [lambda r: plain_toxic(spark, path, r), plain_lines, plain_copies, lambda r: plain_leaks(r, items)]
    docs, want = table(spark, path, "documents"), rows
    for (name, apply), model in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before, want = want, model(want)
        docs = stage(apply(spark, docs, path), f"test_{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert by_id(docs) == want, name
        assert want != before, name  # every stage has something to do
    mixed = plain_mix(want)
    for out in (corpus_pipeline.STAGES[-1][1](spark, docs, path), corpus_pipeline.run(spark, path)):
        got = {r["doc_id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in out.collect()}
        assert got == mixed


def test_planted_documents_go_and_clean_ones_stay(spark, corpus):
    path, rows, items = corpus
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, path).collect()}
    toxic = {i for i, r in rows.items() if r[1] and "vilest" in r[1]}
    assert not toxic & set(got)
    leaked = {i for i in range(400) if i % 16 == 5}
    assert not leaked & set(got)
    assert {i for i in range(400) if i % 8 in (0, 2, 4, 6, 7)} <= set(got)
    assert sum("stands in very many" in t for t in got.values()) == 1


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_go_by_row_and_columns_keep_their_values(spark, corpus):
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(3, long, 0.5, "a", 1), (7, long + " x", 0.25, "b", 2), (7, "quite another text of some words", 0.75, "c", 3), (None, long, 1.0, "d", 4), (8, None, 1.0, "e", 5), (8, None, 1.0, "f", 6), (9, "w" * 200_000, 1.0, None, 7), (None, "none of these has an id at all", 0.0, "g", 8), (None, "none of these has an id at all", 0.0, "h", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, items string, _bytes int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, corpus[0])
    got = {r["_bytes"] for r in kept.collect()}
    assert kept.columns == docs.columns and got - {8, 9} == {1, 3, 5, 6, 7} and len(got & {8, 9}) == 1
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.dedup_lines, corpus_pipeline.drop_contaminated):
        out = stage(spark, docs, corpus[0])
        assert out.columns == docs.columns
        assert {(r["_bytes"], r["score"], r["items"]) for r in out.collect()} == {(r[4], r[2], r[3]) for r in rows}
    assert corpus_pipeline.mix(spark, docs.withColumn("source", docs["items"]), corpus[0]).count() == len(rows)


def test_mixing_parts_rows_of_one_id(spark):
    from quillspark.llm import mixing

    rows = [(1, " ".join(["w"] * 10), "a")] * 90 + [(i, " ".join(["w"] * 10), "b") for i in range(100, 140)] + [(2, f"{'w ' * 9}{i}", "c") for i in range(50)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 10
