"""Packing documents into sequences of a fixed length by patterns of lengths.

Token sequences that fill a training sequence exactly with one, two or three pieces are
patterns. How often each is used follows from non-negative least squares: pattern counts whose
lengths come nearest to the histogram of piece lengths. The counts are rounded down, what is
left over is packed by best fit on the histogram, and the pieces of each length are then dealt to the
places that the patterns have for it. Only the histogram, at most one row for each length,
reaches the driver.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import stored
from folioframe.llm.token_frames import byte_letters
from folioframe.session import ship_package

SIZE, END = 1024, 2
#: Words remembered by a worker; texts encoded at a time; tokens in a batch of rows.
REMEMBERED, TOGETHER, HELD = 400_000, 256, 1 << 20
#: Patterns that join the fit at a time, and what counts as no gain.
JOINING, LEAST_GAIN = 96, 1e-9
# ASCII marks but for the apostrophe, which may join letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, task int, place long"
SLOTS = "length long, low long, high long, each long, first long, at long"
# The white space of the vocabulary's splitting rule.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = re.compile(f"({SPACE}+)")


def keeps_spaces(vocabulary: str) -> bool:
    """Whether a vocabulary takes texts as they are and splits them by the byte-level rule, where
    a word takes one space before it along and other white space stands alone."""
    with open(vocabulary, encoding="utf-8") as file:
        rules = json.load(file)
    split = rules.get("pre_tokenizer") or {}
    return (
        not rules.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        and all(t["content"].startswith("<|") for t in rules.get("added_tokens", [])))


class Units(dict):
    """The ids of words and of what is between them; those that are asked for are remembered."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.tokenize, self.letters = tokenizer, tokenizer.model.tokenize, byte_letters()

    def __missing__(self, unit: str) -> bytes:
        spaced = unit[:1] == " "
        word = unit[1:] if spaced else unit
        data = None
        if word.isalpha():
            data = self.of_letters(word, spaced)
        # Marks behind letters are one piece of their own.
        elif (base := word.rstrip(MARKS)).isalpha():
            data = self[unit[:len(unit) - len(word) + len(base)]] + self[word[len(base):]]
        if data is None:
            data = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()
        self[unit] = data
        return data

    def of_letters(self, word: str, spaced: bool) -> bytes | None:
        """The ids of letters below 256 alone, straight from the model."""
        if word.isascii():
            seen = "Ġ" + word if spaced else word
        else:
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                return None
            seen = ("Ġ" if spaced else "") + word.encode().decode("latin-1").translate(self.letters)
        ids = [token.id for token in self.tokenize(seen)]
        return struct.pack(f"<{len(ids)}I", *ids)


class SpacedEncoder:
    """Ids of whole texts, as bytes of little-endian 32-bit numbers.

    With a byte-level vocabulary a text's ids are those of its words in a row, each with the
    space before it, and of the white space between them, but for the last space; words that
    come again are not encoded again. Texts that may hold special tokens, and those of other
    vocabularies, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_word = keeps_spaces(vocabulary)
        self.known = Units(self.tokenizer)

    def units(self, text: str) -> list[str]:
        """The words of a text, with the space before them, and what is between."""
        if " ".join(text.split()) == text.replace("\n", " "):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        out, spaced = [], ""
        for number, part in enumerate(SPACES.split(text)):
            if number % 2 == 0:
                out.append(spaced + part)
                spaced = ""
            elif part[-1] == " ":
                out.append(part[:-1])
                spaced = " "
            else:
                out += (part[:-1], part[-1])
        if spaced and len(out) > 1 and out[-1] == spaced:
            out[-2:] = [out[-2] + spaced]
        elif len(out) > 2 and not out[-1]:
            out[-3:] = [out[-3] + out[-2]]
        return out

    def encoded(self, texts: list[str]) -> list[bytes]:
        whole = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in whole]

    def of(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and "<|" not in t and "\0" not in t for t in texts]
        special = iter(self.encoded([t for t, p in zip(texts, plain, strict=True) if not p]))
        out = []
        for text, own in zip(texts, plain, strict=True):
            if len(self.known) > REMEMBERED:
                self.known.clear()
            out.append(b"".join(map(self.known.__getitem__, self.units(text))) if own else next(special))
        return out


_encoders: dict[str, SpacedEncoder] = {}


def encoder(vocabulary: str) -> SpacedEncoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = SpacedEncoder(vocabulary)
    return _encoders[vocabulary]


def cut(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of PIECES: ``place`` counts the pieces of a length within the task."""
    own = encoder(vocabulary)
    end = np.array([end_id], "<u4").tobytes()
    task = TaskContext.get().partitionId()
    places: dict[int, int] = defaultdict(int)
    names = [x.split()[0] for x in PIECES.split(", ")]
    rows: list[tuple] = []
    data: list[bytes] = []
    held = 0

    def batch_of() -> pa.RecordBatch:
        doc_ids, piece, start, length, checksum, place = zip(*rows, strict=True)
        ids = pa.array(np.frombuffer(b"".join(data), "<u4").astype(np.int32))
        offsets = pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32())
        columns = [pa.array(doc_ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, checksum))]
        columns += [pa.ListArray.from_arrays(offsets, ids), pa.array([task] * len(rows), pa.int32()), pa.array(place, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            doc_ids = part.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, own.of([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                bounds = [0, *range(n % size or size, n + 1, size)]
                for number, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    piece = ids[4 * a:4 * b]
                    rows.append((doc_id, number, a, b - a, zlib.crc32(piece), places[b - a]))
                    places[b - a] += 1
                    data.append(piece)
                    held += b - a
                    if held >= HELD:
                        yield batch_of()
                        rows, data, held = [], [], 0
    if rows:
        yield batch_of()


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All rows of two or three of ``lengths`` that fill ``size`` exactly, largest first; 0 in
    the third place stands for none."""
    present = np.zeros(size + 1, bool)
    present[lengths] = True
    present[0] = True
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    c = size - a - b
    kept = (a >= b) & (b >= c) & (c >= 0)
    kept[kept] = present[c[kept]]
    return np.stack((a[kept], b[kept], c[kept]), axis=1)


def fitted(made: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which patterns, and how often each, come nearest to ``counts`` of lengths in squares.

    Non-negative least squares with a set of patterns in use: those that the error asks for most
    join, those that the plain solution makes negative leave, until a round gains less than half
    a piece. Errors weigh as the square of the length, since short pieces fill gaps anyway.
    """
    weight = (np.arange(size + 1) / size) ** 2
    wanted = counts * weight
    lengths = np.arange(size + 1)[:, None]
    used, base, times, error = np.zeros(0, np.int64), np.zeros((size + 1, 0)), np.zeros(0), wanted
    while len(made):
        asked = (error * weight)[made].sum(axis=1)
        asked[used] = 0
        most = np.argsort(-asked, kind="stable")[:JOINING]
        most = most[asked[most] > LEAST_GAIN]
        joined = sum((made[most, place] == lengths).astype(np.float64) for place in range(3)) * weight[:, None]
        tried, columns = np.concatenate((used, most)), np.concatenate((base, joined), axis=1)
        while True:
            products = columns.T @ columns
            products[np.diag_indices_from(products)] += LEAST_GAIN
            solution = np.linalg.solve(products, columns.T @ wanted)
            if (solution > 0).all():
                break
            tried, columns = tried[solution > 0], columns[:, solution > 0]
        left = wanted - columns @ solution
        if left @ left > error @ error - 0.5:
            break
        used, base, times, error = tried, columns, solution, left
    return used, times


def best_fit(counts: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, of ``counts`` pieces of each length, sequences alike together:
    each with its ``(length, times)`` and how many there are."""
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = defaultdict(list)
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            free = next((f for f in range(length, size) if room[f]), size)
            held, many = room[free].pop() if free < size else ([], left)
            each = min(free // length, left)
            taken = min(many, left // each)
            if taken < many and free < size:
                room[free].append((held, many - taken))
            room[free - each * length].append(([*held, (length, each)], taken))
            left -= each * taken
    return [group for _, groups in sorted(room.items()) for group in groups]


def planned(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows of SLOTS: the pieces ``low`` to ``high`` of a length are dealt, ``each`` to a
    sequence, to the sequences from ``first`` on, where they stand from ``at`` on."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    # Full pieces are sequences by themselves.
    left = counts.copy()
    left[size] = 0
    made = patterns(np.flatnonzero(left), size)
    used, times = fitted(made, left.astype(np.float64), size)
    groups: list[tuple[list[tuple[int, int]], int]] = [([(size, 1)], int(counts[size]))] if counts[size] else []
    for which in np.argsort(-times, kind="stable").tolist():
        lengths, each = np.unique(made[used[which]], return_counts=True)
        lengths, each = lengths[lengths > 0], each[lengths > 0]
        many = min(int(times[which]), int((left[lengths] // each).min()))
        if many > 0:
            left[lengths] -= each * many
            groups.append((list(zip(lengths.tolist(), each.tolist(), strict=True)), many))
    slots, dealt, first = [], defaultdict(int), 0
    for held, many in groups + best_fit(left, size):
        at = 0
        for length, each in held:
            slots.append((length, dealt[length], dealt[length] + many * each, each, first, at))
            dealt[length] += many * each
            at += length * each
        first += many
    return slots


def packed(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset`` of every piece of
    ``docs(doc_id, text)``.

    A text's ids and the end id are one piece, or, if there are more than ``size``, as many full
    pieces as they hold behind a shorter first one. Null and empty texts are the end id alone.
    Rows that repeat or have no id are pieces of their own; which of several equal lengths goes
    where is open. An empty table gives no rows. Only the two columns are read.
    """
    ship_package(docs.sparkSession)
    spark = docs.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut(batches, vocabulary, end_id, size)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = stored(read.mapInArrow(pieces, PIECES), "packing-pieces")
    counts = stored(made.groupBy("length", "task").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    slots = spark.createDataFrame(planned(histogram, size), SLOTS)
    ranked = made.join(starts, ["length", "task"]).withColumn("_rank", F.col("place") + F.col("_start"))
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
    step = F.col("_rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32", "ids",
        (F.col("first") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("at") + step % F.col("each") * ranked["length"]).alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids, parts``: the packed sequences, each with the documents in it."""
    row = F.struct("offset", "doc_id", "piece", "length", "ids")
    held = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("_held"))
    return held.select(
        "sequence_id", F.aggregate("_held", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.flatten(F.transform("_held", lambda p: p["ids"])).alias("ids"), F.transform("_held", lambda p: p.dropFields("ids")).alias("parts"))
