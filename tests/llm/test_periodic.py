"""Periodic runs against brute force: all runs of small texts, and the query on given tables."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioframe.llm import periodic, queries
from tests.conftest import ROOT


def brute(words, least, repeats):
    """All runs, period by period; a run's period is the smallest that its stretch has."""
    found = set()
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            stretch = words[i:i + length]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(least, repeats * q) and not smaller:
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 3), st.integers(2, 9))
def test_all_runs_of_small_texts(text, repeats, least):
    assert list(map(tuple, periodic.runs_of(text, least, repeats).tolist())) == brute(text, least, repeats)


def test_tree_holds_every_suffix_once():
    text = [1, 2, 1, 1, 2, 1, 2, 2, 1, 9]
    kids, begin, end = periodic.suffix_tree(text)
    seen = {}

    def walk(node, word):
        for letter, child in kids[node].items():
            if child < 0:
                seen[~child] = word + text[~child + len(word):]
                assert text[~child + len(word)] == letter
            else:
                edge = text[begin[child]:end[child]]
                assert edge[0] == letter and len(kids[child]) > 1
                walk(child, word + edge)

    walk(0, [])
    assert seen == {i: text[i:] for i in range(len(text))}


def test_extensions_are_common_prefixes():
    rng = random.Random(5)
    text = [rng.randrange(3) for _ in range(200)] + [7]
    known = periodic.Extensions(text, True)
    pairs = [(a, b) for a in range(0, 200, 3) for b in range(1, 200, 7) if a != b]
    a, b = np.array(pairs).T
    for (x, y), common in zip(pairs, known.of(a, b).tolist(), strict=True):
        k = 0
        while text[x + k:x + k + 1] == text[y + k:y + k + 1]:
            k += 1
        assert common == k


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 9), st.integers(0, 3)), max_size=4), max_size=4))
def test_stretches_lose_no_run(plans):
    documents = []
    for number, plan in enumerate(plans):
        words = []
        for period, times, spare in plan:
            words += [b"w%d" % i for i in range(period)] * times + [b"u%d-%d" % (number, len(words) + i) for i in range(spare)]
        documents.append(words)
    runs, starts = periodic.runs_in(documents)
    wanted = [(starts[i] + s, length, q) for i, words in enumerate(documents) for s, length, q in brute(words, 24, 3)]
    assert list(map(tuple, runs.tolist())) == wanted


def summary_of(doc_id, text):
    words = queries.repeated_tail(doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    runs = brute(words, 24, 3)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(best or (None, None, None)), best and best[1] * 1000 // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, ROOT).collect()}
    assert len(rows) == len(docs)
    short = [r for r in docs if len(r.text or "") < 6000]
    assert len(short) > 150
    assert {r.doc_id: rows[r.doc_id] for r in short} == {r.doc_id: summary_of(r.doc_id, r.text) for r in short}
    assert sum(r[1] > 0 for r in rows.values()) > 5


def test_repeated_tail_as_defined():
    words = [b"%d" % i for i in range(50)]
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            assert queries.repeated_tail(doc_id, words) == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
        else:
            assert queries.repeated_tail(doc_id, words) == words
    assert queries.repeated_tail(None, words) == words


CASES = [
    (1, None), (2, ""), (3, " \t\n\v\f\r "), (None, "a b " * 12), (None, None), (5, "x " * 23), (5, "x " * 24), (5, "x " * 24),
    (6, "one two three " * 8), (7, "Ä ß " * 30 + "ende"), (8, "a b a b c " * 6 + "a b " * 20),
]


def test_edges(spark):
    rows = [(i, t, "clash", 1) for i, t in CASES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = sorted(map(tuple, periodic.summary(periodic.periodic_runs(docs)).collect()), key=str)
    plain = []
    for i, text in CASES:
        plain.append((i, *summary_of(None, text)[1:]))
    assert got == sorted(plain, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.summary(periodic.periodic_runs(docs)).collect() == []


@pytest.mark.parametrize("text, runs", [
    ("w " * 100_000, [(0, 100_000, 1)]),
    (" ".join(str(i) for i in range(40_000)) * 2, []),
    (" ".join(str(i) for i in range(20_000)) + (" " + " ".join(str(-i) for i in range(7_000))) * 4, [(20_000, 28_000, 7_000)]),
])
def test_very_long_texts(spark, text, runs):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert [tuple(r) for r in row.runs] == runs
    assert len(row.collapsed.split()) == len(text.split()) - sum(length - q for _, length, q in runs)
