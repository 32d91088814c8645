"""The pipeline's near copies: pairs looked at in crowds, and exact groups on given tables."""

import numpy as np
import pytest

from folioframe.llm import simhash
from folioframe.llm.common import components, contracted
from tests.conftest import ROOT


def crowd(spark, n, seed, apart=0.1):
    """Sets of one crowd under two keys: sketches that agree in about (1 - apart) ** 2."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 251, 144)
    rows = []
    for i in range(n):
        sign = np.where(rng.random(144) < apart, rng.integers(0, 251, 144), base).astype(np.uint8)
        fp = int(np.int64(0x1234567) ^ (np.int64(1) << np.int64(rng.integers(0, 60))))
        rows.append((i, fp, [1, 2], sign.tobytes()))
    return spark.createDataFrame(rows, "id long, fp long, keys array<long>, sign binary")


def connected(pairs, n):
    root = np.arange(n)
    a, b = (np.array([p[x] for p in pairs], np.int64) for x in (0, 1))
    simhash.united(root, a, b)
    return len(np.unique(root))


def test_pairs_of_a_set_do_not_grow_with_its_crowd(spark):
    each = {}
    for n in (512, 2048, 8192):
        pairs = simhash.likely_pairs(crowd(spark, n, 3)).collect()
        assert connected(pairs, n) == 1
        each[n] = len(pairs) / n
    assert each[8192] < 1.2 * each[2048] < 1.5 * each[512]


def test_no_likely_pair_is_unconnected(spark):
    # A few sets are far from the crowd's middle: each is likely with few others, in other blocks.
    n = 1500
    sets = crowd(spark, n, 9, apart=0.26)
    rows = sets.collect()
    signs = np.array([np.frombuffer(r.sign, np.uint8) for r in rows])
    root = np.arange(n)
    for i in range(1, n):
        near = np.flatnonzero((signs[:i] == signs[i]).mean(axis=1) >= simhash.LIKELY)
        simhash.united(root, np.full(len(near), i), near)
    found = simhash.likely_pairs(sets).collect()
    assert connected(found, n) == len(np.unique(root))


@pytest.mark.parametrize("folder", [ROOT])
def test_groups_of_the_given_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sets = {r.doc_id: np.unique(simhash.shingle_hashes(r.text, simhash.WIDE)) for r in docs.collect()}
    ids = sorted(sets)
    place = {i: k for k, i in enumerate(ids)}
    root = np.arange(len(ids))
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= simhash.SIMILAR * (len(a) + len(b) - both):
                simhash.united(root, np.array([place[i]]), np.array([place[j]]))
    kept = {r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect()}
    assert kept == {ids[k] for k in np.flatnonzero(root == np.arange(len(ids)))}


def test_contraction_finds_the_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 - i, 1000 - i - 1) for i in range(200)] + [(2000, 2000)]
    edges += [tuple(map(int, e)) for e in rng.integers(3000, 3400, (150, 2))] + [(5000, 5000 + i) for i in range(1, 400)]
    frame = spark.createDataFrame(edges + edges[:50], "a long, b long")
    got = {r.v: r.root for r in contracted(frame, "test").collect()}
    want = {r.v: r.root for r in components(frame.filter("a <> b"), "test").collect()}
    assert got == want
    assert contracted(frame.limit(0), "test").collect() == []
