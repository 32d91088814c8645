"""The registered queries against their SQL or a brute-force version, on the smallest tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from folioframe.llm import class_ngram, queries
from tests.conftest import ROOT
from tests.test_oracle import plain


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.asDict() for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(name, spark, duck):
    df = queries.QUERIES[name](spark, ROOT)
    cur = duck.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cur.fetchall())


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts == 2


def test_op1_counts_and_gains(spark, docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(d["text"])) + [""] for i, d in docs.items()}
    counts = Counter(w for i, own in words.items() if not held_out(i, 7) for w in own)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op1_class_ngram(spark, ROOT).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        own = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held_out(r.doc_id, 7), len(own), n)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op1_probabilities_sum_to_one(spark):
    texts = [("a b a c",), ("b b a",), (None,), ("c d",)]
    frame = spark.createDataFrame([(i, t) for i, (t,) in enumerate(texts)], "doc_id long, text string")
    counts = class_ngram.word_counts(frame)
    model = class_ngram.train(frame, counts)
    seen = dict(zip(model.words.index, model.words.counts, strict=True))
    for before in range(class_ngram.CLASSES):
        total = 0.0
        present = set()
        for word, count in seen.items():
            c = model.classes[model.words.units_of([word])[1][0]]
            present.add(c)
            total += 10 ** (model.transition[before, c] + model.known[c]) * count
        total += sum(10 ** (model.transition[before, c] + model.unknown[c]) for c in present)
        absent = sum(10 ** model.transition[before, c] for c in range(class_ngram.CLASSES) if c not in present)
        assert math.isclose(total + absent, 1, rel_tol=1e-6)


def test_op1_gain_of_a_move_is_the_change_of_the_objective(monkeypatch):
    monkeypatch.setattr(class_ngram, "CLASSES", 6)
    rng = np.random.default_rng(3)
    text, classes = rng.integers(0, 20, 3000), rng.integers(0, 6, 20)

    def table(own):
        out = np.zeros((6, 6))
        np.add.at(out, (own[text[:-1]], own[text[1:]]), 1)
        return out

    after, before, alike = np.zeros(6), np.zeros(6), 0.0
    for a, b in zip(text[:-1], text[1:], strict=True):
        if a == 4:
            after[classes[b]] += 1
        if b == 4:
            before[classes[a]] += 1
        alike += a == b == 4
    found = class_ngram.gains(table(classes), classes[4], after, before, alike)
    wanted = []
    for c in range(6):
        moved = classes.copy()
        moved[4] = c
        wanted.append(class_ngram.objective(table(moved)))
    assert np.allclose(found - found[0], np.array(wanted) - wanted[0])


def test_op2_ids_from_the_files(spark, docs):
    tokenizer, start = Tokenizer.from_file(queries.tokenizer_file()), 0
    rows = {r.doc_id: r for r in queries.op2_token_frames(spark, ROOT).collect()}
    assert len(rows) == len(docs)
    for i in sorted(docs):
        ids = np.array([*tokenizer.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op3_fingerprints_and_components(spark, docs):
    marks = {i: simhash(d["text"]) for i, d in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (marks[i] ^ marks[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    rows = queries.op3_simhash_dedup(spark, ROOT).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{marks[i]:016x}", find(i)) for i in ids}
    assert len(rows) == len(ids)


def test_op7_held_out_accuracy(spark, docs):
    rows = queries.op7_language_id(spark, ROOT).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == held_out(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id]["lang"] for r in unseen) >= 0.97 * len(unseen)


def test_op9_held_out_accuracy(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    rows = queries.op9_cotraining_quality(spark, ROOT).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.keep == (labels[r.doc_id] == 1) for r in unseen) >= 0.85 * len(unseen)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, ROOT).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if name != "token_frames":
            assert docs.columns == columns
            assert docs.join(before, columns, "left_anti").count() == 0
    texts = spark.read.parquet(str(tmp_path / "near_duplicates")).select("text")
    assert texts.distinct().count() == texts.count()
    assert docs.count() == spark.read.parquet(str(tmp_path / "mixture")).count()
    ran = corpus_pipeline.run(spark, ROOT)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, docs.collect()))
