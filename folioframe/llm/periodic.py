"""Periodic runs of words by suffix trees.

A run is a stretch whose words are the same ``period`` apart and which no neighbour extends.
Every run is met from a Lyndon root: of the two orders of words, one makes the longest Lyndon
word at some place of the run one period long. The longest Lyndon words end at the next smaller
suffix, so both orders are read off one walk of the suffix tree; each candidate is extended to
the right by the longest common extension of its two ends, the depth of their lowest common
ancestor in the tree, and to the left by the same in the tree of the reversal.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.session import ship_package

#: A run has this many words and repeats of its period at least.
LEAST, REPEATS = 24, 3
#: Words that occur in no run do not enter a tree: each GRAM words in a row within a run come
#: again in it, GRAM being LEAST / REPEATS. Words of documents that share trees.
GRAM, TOGETHER = 8, 1 << 17
RUN = "struct<start: bigint, length: bigint, period: bigint>"
FOUND = f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"


def suffix_tree(text: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's tree of ``text``, whose last letter occurs once: for each inner node its
    children by first letter, and where its edge begins and ends in the text.

    Node 0 is the root; ~k stands for the leaf of suffix k.
    """
    kids: list[dict[int, int]] = [{}]
    begin, end, link = [0], [0], [0]
    leaf_begin: list[int] = []
    node = at = length = pending = 0
    for i, letter in enumerate(text):
        pending += 1
        fresh = 0
        while pending:
            own = kids[node]
            if not length:
                if letter in own:
                    at, length = i, 1
                    if fresh:
                        link[fresh] = node
                    break
                own[letter] = ~len(leaf_begin)
                leaf_begin.append(i)
                if fresh:
                    link[fresh] = node
                    fresh = 0
            else:
                first = text[at]
                child = own[first]
                if child < 0:
                    edge = leaf_begin[~child]
                else:
                    edge = begin[child]
                    span = end[child] - edge
                    if length >= span:
                        node = child
                        at += span
                        length -= span
                        continue
                middle = edge + length
                if text[middle] == letter:
                    length += 1
                    if fresh:
                        link[fresh] = node
                    break
                new = own[first] = len(kids)
                kids.append({text[middle]: child, letter: ~len(leaf_begin)})
                leaf_begin.append(i)
                begin.append(edge)
                end.append(middle)
                link.append(0)
                if child < 0:
                    leaf_begin[~child] = middle
                else:
                    begin[child] = middle
                if fresh:
                    link[fresh] = new
                fresh = new
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return kids, begin, end


class Extensions:
    """Longest common extensions of a text's suffixes in constant time each.

    ``first`` is where a suffix's leaf stands in the Euler tour, so it also orders the suffixes.
    The tour notes depths in letters; the least depth between two leaves is that of their lowest
    common ancestor, and a table of minima over powers of two gives it at once.
    """

    def __init__(self, text: list[int], ordered: bool):
        kids, begin, end = suffix_tree(text)
        n = len(text)
        first, tour = [0] * n, []
        nodes, depths = [0], [-1]
        while nodes:
            node, depth = nodes.pop(), depths.pop()
            if depth < 0:
                depth = ~depth
            else:
                tour.append(depth)
            if node < 0:
                first[~node] = len(tour)
                tour.append(n + 1 + node)
                continue
            depth += end[node] - begin[node]
            own = kids[node]
            below = [own[x] for x in sorted(own, reverse=True)] if ordered else list(own.values())
            nodes += below
            depths += [depth] * len(below)
            depths[-1] = ~depth
        self.first = np.array(first, np.int64)
        self.size = len(tour)
        rows = [np.array(tour, np.int32)]
        for power in range(self.size.bit_length() - 1):
            row, step = rows[-1], 1 << power
            rows.append(np.concatenate((np.minimum(row[:-step], row[step:]), row[-step:])))
        self.minima = np.concatenate(rows)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters the suffixes a and b, which differ, have in common."""
        x, y = self.first[a], self.first[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        power = np.frexp((high - low + 1).astype(np.float64))[1].astype(np.int64) - 1
        row = power * self.size
        return np.minimum(self.minima[row + low], self.minima[row + high + 1 - (1 << power)]).astype(np.int64)


def next_smaller(rank: list[int]) -> list[int]:
    """Of each place the next one of a smaller rank, or the length."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 1, -1, -1):
        own, j = rank[i], i + 1
        while j < n and rank[j] > own:
            j = out[j]
        out[i] = j
    return out


def runs_of(text: list[int], least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of ``text`` that have ``least`` letters and
    ``repeats`` periods, two at least, by start and period."""
    final = max(text, default=0) + 1
    n = len(text) + 1
    ahead = Extensions([*text, final], True)
    behind = Extensions([final, *text[::-1], final + 1], False)
    rank = ahead.first.tolist()
    ends = np.array((next_smaller(rank), next_smaller([-x for x in rank])))
    start = np.tile(np.arange(n), 2)
    stop = ends.ravel()
    inside = (stop < n) & ((stop - start) * (repeats - 1) <= n - start)
    start, stop = start[inside], stop[inside]
    period = stop - start
    right = ahead.of(start, stop)
    left = behind.of(n - start, n - stop)
    length = left + period + right
    long = (length >= least) & (length >= repeats * period)
    runs = np.unique(np.stack((start - left, period, length), axis=1)[long], axis=0)
    return runs[:, [0, 2, 1]]


def stretches(ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches that may hold runs: LEAST words or more, each within
    GRAM words in a row that come again in the same document ``own``.

    Grams are compared by hashes; a clash lets a stretch in, it never keeps one out.
    """
    none = np.zeros(0, np.int64)
    n = len(ids) - GRAM + 1
    if n < 1:
        return none, none
    grams = own[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for step in range(GRAM):
        grams = (grams ^ ids[step:step + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    ranked = np.sort(grams)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not twice.size:
        return none, none
    again = (twice[np.minimum(np.searchsorted(twice, grams), len(twice) - 1)] == grams) & (own[:n] == own[GRAM - 1:])
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += again
    edges[GRAM:] -= again
    covered = np.cumsum(edges[:-1]) > 0
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    opens = np.flatnonzero(covered & (fresh | ~np.concatenate(([False], covered[:-1]))))
    closes = np.flatnonzero(covered & np.concatenate((fresh[1:] | ~covered[1:], [True]))) + 1
    enough = closes - opens >= LEAST
    return opens[enough], closes[enough]


def runs_in(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All runs of some documents, as rows with starts in their words put in a row, and where
    each document starts there."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    sizes = [len(words) for words in documents]
    starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    ids = np.fromiter((number[w] for words in documents for w in words), np.int64, int(starts[-1]))
    opens, closes = stretches(ids, np.repeat(np.arange(len(documents)), sizes))
    if not opens.size:
        return np.zeros((0, 3), np.int64), starts
    # One text of all stretches, parted by letters that occur once, which no run can hold.
    alone = len(number)
    text: list[int] = []
    shift = np.zeros(len(opens), np.int64)
    for i, (a, b) in enumerate(zip(opens.tolist(), closes.tolist(), strict=True)):
        shift[i] = len(text)
        text += ids[a:b].tolist()
        text.append(alone + i)
    runs = runs_of(text)
    within = np.searchsorted(shift, runs[:, 0], side="right") - 1
    runs[:, 0] += opens[within] - shift[within]
    return runs, starts


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def examined(rewrite: Rewrite | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def results(ids: list[int | None], documents: list[list[bytes]]) -> pa.RecordBatch:
        runs, starts = runs_in(documents)
        edges = np.zeros(int(starts[-1]) + 1, np.int64)
        np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(edges[:-1]) == 0
        bounds = np.searchsorted(runs[:, 0], starts)
        texts = []
        for i, words in enumerate(documents):
            if bounds[i] < bounds[i + 1]:
                words = compress(words, kept[starts[i]:starts[i + 1]].tolist())
            texts.append(b" ".join(words))
        first = runs[:, 0] - np.repeat(starts[:-1], np.diff(bounds))
        rows = pa.StructArray.from_arrays(
            [pa.array(first), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows),
             pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        documents: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                ids.append(doc_id)
                documents.append(rewrite(doc_id, words) if rewrite else words)
                held += len(documents[-1])
                if held >= TOGETHER or len(ids) >= TOGETHER:
                    yield results(ids, documents)
                    ids, documents, held = [], [], 0
        if ids:
            yield results(ids, documents)

    return of


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs(doc_id, text)``.

    ``runs`` holds all runs of LEAST words and REPEATS periods or more, by start and then period;
    ``collapsed`` the words that stay, with single spaces, once each run is cut to its first
    period. ``rewrite(doc_id, words)`` may change the words first. Words are parted by ASCII
    white space and compared as bytes. Null, empty and blank texts have no words, no runs and an
    empty text; rows that repeat or have no id come out as they came in; an empty table gives no
    rows. Only the two columns are read. A task holds its documents in portions of about
    TOGETHER words; a longer one is a portion of its own, whole.
    """
    ship_package(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(examined(rewrite), FOUND)


def strongest(runs: Column) -> Column:
    """The run of most repeats; of several the first, then that of the shortest period."""
    def better(a: Column, b: Column) -> Column:
        more = b["length"] * a["period"] > a["length"] * b["period"]
        return F.when(a.isNull() | more, b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def summary(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of ``periodic_runs``; nulls where there is no run."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(""))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 DIV best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
