"""LM scoring with Brown classes: exchange clustering, class transitions, word emissions."""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import held_out, stored
from folioframe.session import ship_package

# The FREQUENT commonest words at most are known to every task, with their counts; all others
# meet their counts in a join. Of these, OWN words are clustered one by one; every other word
# belongs to one of POOLS pools by its CRC and moves with its pool. The end of a text is a unit
# and a class of its own.
FREQUENT, OWN, POOLS, CLASSES, ROUNDS = 131_072, 16_384, 4_096, 64, 10
UNITS, END_UNIT, END_CLASS = OWN + POOLS + 1, OWN + POOLS, CLASSES - 1
END, SPAN = b"", 256
TOGETHER, GATHERED, HELD, PARTS = 256, 4_000_000, 300_000, 64
STEPS = 8


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words with A-Z in lower case; between them ASCII white space."""
    return text.encode().lower().split() if text else []


def pool(word: bytes) -> int:
    return OWN + zlib.crc32(word) % POOLS


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all tokens of ``docs(text)``; the end of a text is the empty word."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(words_of(text))
                held[END] += 1
                if len(held) > HELD:
                    yield flushed()
        yield flushed()

    return docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """The commonest words with their counts; every word seen ``least`` times or more is in."""

    index: dict[bytes, int]
    counts: np.ndarray
    units: np.ndarray
    least: int

    def units_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The place (-1: not here) and the unit of each word."""
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        units = self.units[at] if len(self.units) else np.zeros(len(words), np.int64)
        rare = np.flatnonzero(at < 0)
        if rare.size:
            units[rare] = [pool(words[i]) for i in rare.tolist()]
        return at, units


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words above a count that at most FREQUENT words reach, found from a histogram."""
    step = F.floor(F.log2("n") * STEPS)
    sizes = {r.step: (r.words, r.least) for r in counts.groupBy(step.alias("step")).agg(
        F.count("*").alias("words"), F.min("n").alias("least")).collect()}
    least, total = 1 << 62, 0
    for key in sorted(sizes, reverse=True):
        total += sizes[key][0]
        if total > FREQUENT:
            break
        least = sizes[key][1]
    rows = counts.filter((F.col("n") >= least) | (F.col("word") == F.lit(END))).toArrow()
    ranked = sorted(zip(rows["n"].to_pylist(), rows["word"].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    index = {word: i for i, (_, word) in enumerate(ranked)}
    units = np.array([END_UNIT if w == END else i if i < OWN else pool(w) for i, (_, w) in enumerate(ranked)], np.int64)
    return Vocabulary(index, np.array([n for n, _ in ranked], float), units, least)


def flat(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of some texts in a row, each closed by its end, and where each text starts."""
    tokens: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(tokens))
        tokens += words_of(text)
        tokens.append(END)
    return tokens, np.array(starts, np.int64)


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes and their counts, small."""
    steps = np.diff(codes, prepend=0).astype("<u4").tobytes()
    return zstandard.compress(struct.pack("<I", len(codes)) + steps + counts.astype("<u8").tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    plain = zstandard.decompress(data)
    n = struct.unpack_from("<I", plain)[0]
    return np.cumsum(np.frombuffer(plain, "<u4", n, 4), dtype=np.int64), np.frombuffer(plain, "<u8", n, 4 + 4 * n).astype(np.int64)


def unit_pairs(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """How often each unit follows each: ``range, after, before``, a row per SPAN units.

    ``after`` holds the pairs whose first unit is in the range, ``before`` those whose second
    is. Tasks send sums of some million tokens; a range adds them up in a matrix of fixed size.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    schema = "range int, side int, data binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        part = TaskContext.get().partitionId() % PARTS

        def blocks() -> Iterator[pa.RecordBatch]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            first, second = np.divmod(codes, UNITS)
            for side, (own, other) in enumerate(((first, second), (second, first))):
                order = np.lexsort((other, own)) if side else slice(None)
                own, other, times = own[order], other[order], counts[order]
                ranges = own // SPAN
                cuts = np.flatnonzero(np.diff(ranges, prepend=-1, append=-1))
                rows = [(int(ranges[a]), side, packed((own[a:b] % SPAN) * UNITS + other[a:b], times[a:b]))
                        for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)),
                     pa.array([part] * len(rows), pa.int32())], names=["range", "side", "data", "part"])

        gathered = 0
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                tokens, _ = flat(batch.column("text").slice(at, TOGETHER).to_pylist())
                units = np.concatenate(([END_UNIT], shared.value.units_of(tokens)[1]))
                held.append(units[:-1] * UNITS + units[1:])
                gathered += len(tokens)
                if gathered >= GATHERED:
                    yield from blocks()
                    gathered = 0
        if held:
            yield from blocks()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(SPAN * UNITS, np.int64), None

        def total() -> pa.RecordBatch:
            codes = np.flatnonzero(matrix)
            data = packed(codes, matrix[codes])
            matrix[codes] = 0
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([data], pa.binary())], names=["range", "side", "data"])

        for batch in batches:
            for number, side, data in zip(*(batch.column(x).to_pylist() for x in ("range", "side", "data")), strict=True):
                if now and (number, side) != now:
                    yield total()
                now = number, side
                codes, counts = unpacked(data)
                matrix[codes] += counts
        if now:
            yield total()

    parts = docs.select("text").mapInArrow(sums, f"{schema}, part int")
    # First by parts of a range, so that many tasks share the work, then by range.
    some = parts.repartition("range", "part").sortWithinPartitions("range", "side").mapInArrow(merged, schema)
    whole = some.repartition("range").sortWithinPartitions("range", "side").mapInArrow(merged, schema)
    of_side = lambda n: F.coalesce(F.max(F.when(F.col("side") == n, F.col("data"))), F.lit(packed(np.zeros(0, int), np.zeros(0, int))))
    return stored(whole.groupBy("range").agg(of_side(0).alias("after"), of_side(1).alias("before")), "class-pairs")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def objective(table: np.ndarray) -> float:
    """What the likelihood of the class bigrams depends on."""
    return float(xlogx(table).sum() - xlogx(table.sum(axis=1)).sum() - xlogx(table.sum(axis=0)).sum())


def gains(table: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self_pairs: float) -> np.ndarray:
    """The objective, less a constant, with a unit of class ``own`` put in each class.

    ``after`` and ``before`` count the classes that follow and precede the unit.
    """
    after, before = after.astype(float), before.astype(float)
    after[own] -= self_pairs
    before[own] -= self_pairs
    rest = table.astype(float)
    rest[own] -= after
    rest[:, own] -= before
    rest[own, own] -= self_pairs
    diagonal = np.diag(rest)
    nexts, lasts = np.flatnonzero(after), np.flatnonzero(before)
    out = (xlogx(rest[:, nexts] + after[nexts]) - xlogx(rest[:, nexts])).sum(axis=1)
    out += (xlogx(rest[lasts] + before[lasts, None]) - xlogx(rest[lasts])).sum(axis=0)
    out += xlogx(diagonal + after + before + self_pairs) + xlogx(diagonal) - xlogx(diagonal + after) - xlogx(diagonal + before)
    for margin, more in ((rest.sum(axis=1) + before, after.sum()), (rest.sum(axis=0) + after, before.sum())):
        out -= xlogx(margin + more + self_pairs) - xlogx(margin)
    return out


def context(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the units of a range: counts of the classes beside them, and of all single pairs."""
    codes, counts = unpacked(data)
    local, other = np.divmod(codes, UNITS)
    table = np.bincount(local * CLASSES + classes[other], weights=counts, minlength=SPAN * CLASSES)
    return table.reshape(SPAN, CLASSES), np.stack([local, other, counts])


def exchange(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all units and the counts of class pairs, after ROUNDS rounds of exchange.

    Half of the units move at a time, each to the class where the likelihood would be highest
    if it alone moved. Ranges of units are judged by tasks; the driver holds one number per
    unit and the table of class pairs, both of fixed size. The best of all rounds is kept.
    """
    spark = pairs.sparkSession
    classes = np.arange(UNITS) % END_CLASS
    classes[END_UNIT] = END_CLASS
    best = None
    for turn in range(ROUNDS + 1):
        now = spark.sparkContext.broadcast(classes)

        def summed(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            table = np.zeros((CLASSES, CLASSES))
            for batch in batches:
                for number, data in zip(batch.column("range").to_pylist(), batch.column("after").to_pylist(), strict=True):
                    own = now.value[number * SPAN:(number + 1) * SPAN]
                    np.add.at(table, own, context(data, now.value)[0][:len(own)])
            yield pa.RecordBatch.from_arrays([pa.array([table.astype("<i8").tobytes()], pa.binary())], names=["table"])

        table = np.zeros((CLASSES, CLASSES), np.int64)
        for row in pairs.mapInArrow(summed, "table binary").toLocalIterator():
            table += np.frombuffer(row.table, "<i8").reshape(CLASSES, CLASSES)
        value = objective(table)
        if best is None or value > best[0]:
            best = value, classes, table
        if turn == ROUNDS:
            break
        whole = spark.sparkContext.broadcast(table)

        def moved(batches: Iterator[pa.RecordBatch], now=now, whole=whole, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, *data in zip(*(batch.column(x).to_pylist() for x in ("range", "after", "before")), strict=True):
                    (after, pairs_of), (before, _) = (context(x, now.value) for x in data)
                    first = number * SPAN
                    alike = np.zeros(SPAN)
                    mine = pairs_of[0] + first == pairs_of[1]
                    alike[pairs_of[0][mine]] = pairs_of[2][mine]
                    units, chosen = [], []
                    for local in np.flatnonzero(after.any(axis=1)):
                        unit = first + int(local)
                        if unit == END_UNIT or (unit + turn) % 2:
                            continue
                        own = int(now.value[unit])
                        scores = gains(whole.value, own, after[local], before[local], alike[local])[:END_CLASS]
                        if scores.max() > scores[own] + 1e-6:
                            units.append(unit)
                            chosen.append(int(scores.argmax()))
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(chosen, pa.int32())], names=["unit", "class"])

        moves = pairs.mapInArrow(moved, "unit int, class int").toArrow()
        if not moves.num_rows:
            break
        classes = classes.copy()
        classes[moves["unit"].to_numpy()] = moves["class"].to_numpy()
    return best[1], best[2]


@dataclass(frozen=True)
class Model:
    words: Vocabulary
    classes: np.ndarray
    transition: np.ndarray
    known: np.ndarray
    unknown: np.ndarray
    tokens: int
    distinct: int


def smoothed(table: np.ndarray) -> np.ndarray:
    """log10 of the class transitions: Witten-Bell, backing off to the classes' own shares."""
    shares = (table.sum(axis=0) + 1) / (table.sum() + CLASSES)
    rows, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
    return np.log10((table + (kinds + 1) * shares) / (rows + kinds + 1))


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """A model of ``docs(text)`` whose ``word_counts`` are ``counts``.

    A class gives words it has not seen the share of its words that were seen once.
    """
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    words = vocabulary(counts)
    classes, table = exchange(unit_pairs(docs, words))
    once = np.zeros(CLASSES)
    known_once = np.flatnonzero(words.counts == 1)
    np.add.at(once, classes[words.units[known_once]], 1)
    rare_once = counts.filter((F.col("n") == 1) & (F.col("n") < words.least) & (F.col("word") != F.lit(END)))
    for row in rare_once.groupBy(F.pmod(F.crc32("word"), F.lit(POOLS)).alias("pool")).agg(F.count("*").alias("n")).collect():
        once[classes[OWN + row.pool]] += row.n
    tokens = table.sum(axis=0)
    new = np.minimum((once + 0.5) / (tokens + 1), 0.5)
    new[END_CLASS] = 1e-9
    return Model(
        words, classes, smoothed(table), np.log10(1 - new) - np.log10(np.maximum(tokens, 1)), np.log10(new),
        totals.n or 0, totals.v)


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text, held_out)`` with its token counts and log10 scores.

    ``base_score`` is that of single words with one added to each count; ``score`` sums class
    transitions and word emissions. Frequent words are scored where they stand; each document's
    other words meet their counts in a join, spread by word, and are added up by document.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    own_type = "own struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, logs: double, score: double>"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        plus, plain = np.log10(m.words.counts + 1), np.log10(m.words.counts)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                tokens, starts = flat(part.column("text").to_pylist())
                place, units = m.words.units_of(tokens)
                classes = m.classes[units]
                before = np.concatenate(([END_CLASS], classes[:-1]))
                frequent = place >= 0
                logs, total = np.zeros(len(tokens)), m.transition[before, classes]
                if frequent.any():
                    logs[frequent] = plus[place[frequent]]
                    total[frequent] += plain[place[frequent]] + m.known[classes[frequent]]
                sums = [np.add.reduceat(x, starts) for x in (np.ones(len(tokens), np.int64), frequent.astype(np.int64), logs, total)]
                keys = row + np.arange(len(starts))
                row += len(starts)
                own = pa.StructArray.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("held_out"), *map(pa.array, sums)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys), pa.array([b" %d" % k for k in keys.tolist()], pa.binary()), pa.array(np.zeros(len(keys), np.int32)),
                    pa.array(np.zeros(len(keys), np.int32)), own], names=["key", "word", "times", "class", "own"])
                if frequent.all():
                    continue
                rare = np.flatnonzero(~frequent)
                text_of = np.searchsorted(starts, rare, "right") - 1
                found = Counter(zip(text_of.tolist(), classes[rare].tolist(), (tokens[i] for i in rare.tolist()), strict=True))
                text_no, class_no, word = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys[list(text_no)]), pa.array(word, pa.binary()), pa.array(list(found.values()), pa.int32()),
                    pa.array(class_no, pa.int32()), pa.nulls(len(found), own.type)], names=["key", "word", "times", "class", "own"])

    rows = docs.select("doc_id", "text", "held_out").mapInArrow(scored, f"key long, word binary, times int, class int, {own_type}")
    rare = stored(counts.filter(F.col("n") < model.words.least), "class-rare")
    known, unknown = (F.get(F.array(*[F.lit(float(x)) for x in logs]), F.col("class")) for logs in (model.known, model.unknown))
    times, seen = F.col("times"), F.coalesce("n", F.lit(0))
    added = rows.join(rare, "word", "left").select(
        "key", "own", F.when(seen > 0, times).otherwise(0).alias("hits"), (times * F.log10(seen + 1)).alias("logs"),
        F.when(times > 0, times * F.when(seen > 0, F.log10(seen.cast("double")) + known).otherwise(unknown)).otherwise(0.0).alias("emitted"))
    zero = lambda name: F.coalesce(F.col(f"own.{name}"), F.lit(0))
    by_doc = added.groupBy("key").agg(
        F.max("own.doc_id").alias("doc_id"), F.max("own.held_out").alias("held_out"), F.sum(zero("n_tokens")).alias("n_tokens"),
        F.sum(zero("n_known") + F.col("hits")).alias("n_known"), F.sum(zero("logs") + F.col("logs")).alias("logs"),
        F.sum(zero("score") + F.col("emitted")).alias("score"))
    base = F.col("logs") - F.col("n_tokens") * float(np.log10(model.tokens + model.distinct + 1))
    return by_doc.select(
        "doc_id", "held_out", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def language_model(docs: DataFrame, parts: int = 7) -> DataFrame:
    """Train on ``docs(doc_id, text)`` that are not held out and score all of them.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. Null and empty
    texts have their end as only token. A null id is not held out. Repeated rows are scored
    one by one; an empty table gives no rows. Without training rows nothing is known.
    """
    ship_package(docs.sparkSession)
    marked = docs.select("doc_id", "text", held_out("doc_id", parts).alias("held_out"))
    training = marked.filter("NOT held_out")
    counts = stored(word_counts(training), "class-words")
    return score(marked, train(training, counts), counts)
