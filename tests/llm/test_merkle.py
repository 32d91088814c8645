"""Merkle manifest: edge cases against a brute-force tree, and folding with changed leaves."""

import hashlib

import pytest
from pyspark.sql import functions as F

from folioframe.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, digest string, path int, n int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row[:5]
    values = (doc_id, source, lang, None if n_chars is None else n_chars + more, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, i):
    for level in tree[:-1]:
        yield "".join(level[i - i % 2:i]), "".join(level[i + 1:i - i % 2 + 2])
        i //= 2


def expected(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    own = {x: sorted((r for r in rows if r[2] == x), key=order) for x in langs}
    trees = {x: levels([leaf(r) for r in own[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    for number, x in enumerate(langs):
        for i, row in enumerate(own[x]):
            path = [*steps(trees[x], i), *steps(top, number)]
            node = leaf(row, row[0] in tampered)
            for before, after in path:
                node = digest(before, node, after)
            root = top[-1][0]
            yield row[0], leaf(row), trees[x][-1][0], root, digest(*(b + a for b, a in path)), node, node == root


def told(spark, rows, tampered=()):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS)
    named = F.coalesce(F.col("doc_id").isin(*tampered), F.lit(False)) if tampered else F.lit(False)
    out = merkle.verified(docs, named, F.col("n_chars") + 1)
    return sorted(map(tuple, out.collect()), key=str)


CASES = {
    "nulls in every column": [(None, None, None, None, None), (1, None, "en", 2, "a"), (None, "s", "en", 1, None), (2, "", "", 0, "")],
    "one row": [(7, "s", "en", 1, "x")],
    "repeated rows and ids": [(3, "s", "en", 1, "x")] * 5 + [(3, "s", "en", 1, "y"), (3, "s", "de", 1, "x")],
    "long text and wide letters": [(1, "é", "日本", 4, "ß" * 300_000), (2, "é", "zz", 4, "\U0001f600"), (3, "", "é", None, "")],
    "more than a block": [(i, "s", "en" if i % 3 else None, i, f"text {i}") for i in range(merkle.BLOCK * 3 + 1)],
    "many groups": [(i, "s", f"l{i % 70}", i, f"text {i}") for i in range(140)],
}


@pytest.mark.parametrize("name", CASES)
def test_same_as_brute_force(spark, name):
    rows = CASES[name]
    tampered = {1, 3, 64, 100, 190}
    assert told(spark, rows, tampered) == sorted(expected(rows, tampered), key=str)


def test_whole_blocks_have_no_lone_node(spark):
    rows = [(i, "s", "en", i, "t") for i in range(merkle.BLOCK * 2)]
    out = told(spark, rows)
    assert out == sorted(expected(rows, ()), key=str) and all(r[-1] for r in out)


def test_three_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, "s", "en", i, "t") for i in range(37)]
    assert told(spark, rows, {5, 36}) == sorted(expected(rows, {5, 36}), key=str)


def test_empty_table(spark):
    assert told(spark, []) == []
