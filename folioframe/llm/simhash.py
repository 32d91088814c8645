"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import components, contracted, stored
from folioframe.session import ship_package

SHINGLE, SEED, RADIUS, BITS = 3, 42, 3, 64
# Two of five bands agree wherever at most three bits differ, so ten tables of 25 or 26 bits
# find every link. BLOCK bounds what is compared at once, however many fingerprints agree.
BANDS, AGREE, BLOCK = 5, 2, 512
PIECE = 4096
# The pipeline's near copies: sets of five-word shingles with a similarity of 0.8 or more, which
# mostly differ in more than three bits of 64. MINS rows to each of SLOTS keys let 99.9 % meet.
WIDE, SIMILAR, MINS, SLOTS = 5, 0.8, 6, 24
# Bits that copies may differ in at most, and the share of equal min-hashes they have at least;
# how many likely copies on either side are compared before the rest is compared in blocks.
FAR, LIKELY, PARTNERS = 31, 0.7, 3
# Shingles that count as one set of a block, and columns of a matrix of sets.
HEAVY, COLUMNS = 8192, 8192
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set.

    Eight masks count eight bits each in the bytes of a word; 255 hashes fit in a byte.
    """
    counts = np.zeros((8, 8), np.int64)
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[:len(hashes)] = hashes
    for bit in range(8):
        sums = ((padded >> np.uint64(bit)) & LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[:, bit] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of a whole text; of all words, if there are fewer."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[:len(words) - width] + 1)).tolist()
    stops = ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def folded(hashes: np.ndarray) -> int:
    """The SimHash of some hashes as a signed long: the bits that over half of them have."""
    set_bits = (bit_counts(hashes) * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    return folded(shingle_hashes(text, SHINGLE))


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed long."""
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return of(text)


def hexed(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def table_keys(value: Column) -> Column:
    """One key per table: the number of the table above the bits of its bands."""
    widths = [(BITS + i) // BANDS for i in range(BANDS)]
    bands, at = [], 0
    for width in widths:
        bands.append((F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    keys = []
    for number, chosen in enumerate(combinations(bands, AGREE)):
        key = F.lit(number).cast("long")
        for bits, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def bit_planes(values: np.ndarray, spare: int) -> np.ndarray:
    """Row b holds bit b of every value, 64 values to a word, with ``spare`` empty words."""
    words = -(-len(values) // 64) + spare
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def packed(flags: np.ndarray) -> np.ndarray:
    bits = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    bits[:len(flags)] = flags
    return np.packbits(bits, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, step: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """Which lanes i of those ``wanted`` differ from lane i + step in at most 2^k - 1 bits.

    k is the number of bits of ``radius``. The differing bits of 64 lanes are added at a time
    by carry-save counters; a word of lanes is given up once all of it has overflowed.
    """
    live = packed(wanted)
    at = np.flatnonzero(live)
    live = live[at]
    over = np.zeros_like(live)
    counters = [np.zeros_like(live) for _ in range(radius.bit_length())]
    skip, shift = divmod(step, 64)
    for number, plane in enumerate(planes, 1):
        other = plane[at + skip] >> np.uint64(shift)
        if shift:
            other |= plane[at + skip + 1] << np.uint64(64 - shift)
        carry = plane[at] ^ other
        for counter in counters:
            both = counter & carry
            counter ^= carry
            carry = both
        over |= carry
        if number % 4 == 0:
            kept = (live & ~over) != 0
            if not kept.all():
                at, live, over = at[kept], live[kept], over[kept]
                counters = [c[kept] for c in counters]
            if not at.size:
                break
    hits = np.unpackbits((live & ~over).view(np.uint8), bitorder="little").reshape(-1, 64)
    word, bit = np.nonzero(hits)
    return at[word] * 64 + bit


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the lanes of each pair one root, the smallest."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root[:] = above


def forest(group: np.ndarray, block: np.ndarray, own: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group, all values that a chain of small distances
    connects: each value with the first of its part. ``own`` groups compare all their lanes,
    the others only lanes of different blocks."""
    n = len(values)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    largest = int(np.diff(edges).max()) if n else 0
    planes = bit_planes(values, 2 + largest // 64)
    root = np.arange(n)
    for step in range(1, largest):
        wanted = (group[step:] == group[:-step]) & (root[step:] != root[:-step])
        wanted &= own[step:] | (block[step:] != block[:-step])
        if not wanted.any():
            continue
        lane = within(planes, step, wanted, radius)
        lane = lane[np.bitwise_count(values[lane] ^ values[lane + step]) <= radius]
        if lane.size:
            united(root, lane, lane + step)
    moved = np.flatnonzero(root != np.arange(n))
    return values[moved], values[root[moved]]


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the groups of a sorted partition, a bounded number of rows at a time."""
    names = ("key", "i", "j", "block", "fp")
    rest = {x: np.zeros(0, np.int64) for x in names}

    def done(rows: dict[str, np.ndarray], upto: int) -> pa.RecordBatch:
        part = {x: v[:upto] for x, v in rows.items()}
        fresh = np.zeros(upto, bool)
        if upto:
            fresh[1:] = np.any([part[x][1:] != part[x][:-1] for x in ("key", "i", "j")], axis=0)
        a, b = forest(np.cumsum(fresh), part["block"], part["i"] == part["j"], part["fp"].view(np.uint64), RADIUS)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        rows = {x: np.concatenate((rest[x], batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64))) for x in names}
        last = len(rows["key"]) - 1
        if last < 0:
            continue
        same = np.all([rows[x] == rows[x][last] for x in ("key", "i", "j")], axis=0)
        upto = last + 1 - int(same[::-1].argmin() if not same.all() else last + 1)
        if upto:
            yield done(rows, upto)
        rest = {x: v[upto:] for x, v in rows.items()}
    if len(rest["key"]):
        yield done(rest, len(rest["key"]))


def links(values: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that keep every connection.

    Fingerprints meet where two bands agree. A key with more than BLOCK fingerprints is dealt
    to blocks, and each pair of blocks is compared by a task of its own.
    """
    keyed = values.select(F.explode(table_keys(F.col("fp"))).alias("key"), "fp")
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-keys")
    blocks = F.ceil(F.col("n") / BLOCK)
    met = (
        keyed.join(counts, "key")
        .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks"))
        .select("key", "fp", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    )
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text)``.

    Fingerprints that differ in at most three bits are linked; a component is named by its
    smallest document id, nulls aside. Null, empty and blank texts have fingerprint zero and
    are linked like any other. Repeated rows come out as often as they came in; an empty table
    gives no rows. Exact copies share one fingerprint and are compared once.
    """
    ship_package(docs.sparkSession)
    marked = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "simhash-marks")
    values = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    linked = stored(links(values.select("fp")), "simhash-links")
    roots = components(linked, "simhash")
    rooted = stored(
        values.join(roots, values.fp == roots.v, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "simhash-rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_value = stored(rooted.join(named, "root").select("fp", "component_id"), "simhash-named")
    return marked.join(of_value, "fp").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


_RANDOM = np.random.default_rng(SEED).integers(1 << 63, size=(2, MINS * SLOTS), dtype=np.uint64)
_TIMES, _PLUS = _RANDOM[0] * np.uint64(2) + np.uint64(1), _RANDOM[1]


def sketch(text: str | None) -> tuple[int, int, list[int], bytes]:
    """SimHash of the five-word shingles, a hash of their set, the set's min-hash keys, and a
    byte of each min-hash, by whose agreement similarity is estimated."""
    hashes = shingle_hashes(text, WIDE)
    distinct = np.unique(hashes)
    least = np.full(MINS * SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), PIECE):
        least = np.minimum(least, (distinct[at:at + PIECE, None] * _TIMES + _PLUS).min(axis=0))
    rows = least.reshape(SLOTS, MINS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), slot) for slot, row in enumerate(rows)] if len(distinct) else []
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return (
        folded(hashes), signed(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)), list(map(signed, keys)),
        (least % np.uint64(251)).astype(np.uint8).tobytes())


def sketches(text: Column) -> Column:
    @F.pandas_udf("struct<fp: long, content: long, keys: array<long>, sign: binary>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([sketch(t) for t in texts], columns=["fp", "content", "keys", "sign"])

    return of(text)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of five-word shingles; 1 if both are empty."""
    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = np.unique(shingle_hashes(x, WIDE)), np.unique(shingle_hashes(y, WIDE))
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0)
            yield pd.Series(out, dtype="float64")

    return of(a, b)


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose ``texts(id, text)`` are similar enough."""
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "copies-needed")
    wanted = stored(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]), "copies-texts")
    left = wanted.select(F.col("id").alias("a"), F.col("text").alias("_left"))
    right = wanted.select(F.col("id").alias("b"), F.col("text").alias("_right"))
    told = pairs.join(left, "a").join(right, "b").withColumn("_alike", similarity(F.col("_left"), F.col("_right")))
    return told.filter(F.col("_alike") >= least).select("a", "b")


def partners(group: np.ndarray, values: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each lane the likeliest copies among those before and those behind it in its group.

    SimHash distances are compared bit-sliced; pairs within FAR bits are judged by how many
    min-hashes agree, and from LIKELY on the best PARTNERS of either side are proposed, with
    that share. Behind them, with share 0, comes each lane with the first of those that a chain
    of likely pairs connects it with. Groups have BLOCK lanes at most, so a lane gives few pairs.
    """
    n = len(values)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    largest = int(np.diff(edges).max()) if n else 0
    planes = bit_planes(values, 2 + largest // 64)
    best, partner = np.full((2, PARTNERS, n), LIKELY), np.full((2, PARTNERS, n), -1)
    root = np.arange(n)
    for step in range(1, largest):
        wanted = group[step:] == group[:-step]
        if not wanted.any():
            continue
        lane = within(planes, step, wanted, FAR)
        alike = (signs[lane] == signs[lane + step]).mean(axis=1)
        likely = lane[alike >= LIKELY]
        united(root, likely, likely + step)
        for side, (one, other) in enumerate(((lane + step, lane), (lane, lane + step))):
            seat = best[side][:, one].argmin(axis=0)
            better = alike > best[side, seat, one]
            best[side, seat[better], one[better]] = alike[better]
            partner[side, seat[better], one[better]] = other[better]
    side, seat, lane = np.nonzero(partner >= 0)
    moved = np.flatnonzero(root != np.arange(n))
    share = np.concatenate((best[side, seat, lane], np.zeros(len(moved))))
    return np.concatenate((lane, moved)), np.concatenate((partner[side, seat, lane], root[moved])), share


def bridges(group: np.ndarray, block: np.ndarray, part: np.ndarray, values: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes that connect parts by likely pairs of different blocks, one or none for each part.

    Lanes whose parts are one already are not compared, so that a crowd costs nothing.
    """
    _, first, number = np.unique(part, return_index=True, return_inverse=True)
    root = first[number]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    largest = int(np.diff(edges).max()) if len(values) else 0
    planes = bit_planes(values, 2 + largest // 64)
    for step in range(1, largest):
        wanted = (group[step:] == group[:-step]) & (block[step:] != block[:-step]) & (root[step:] != root[:-step])
        if not wanted.any():
            continue
        lane = within(planes, step, wanted, FAR)
        lane = lane[(signs[lane] == signs[lane + step]).mean(axis=1) >= LIKELY]
        united(root, lane, lane + step)
        root = root[root]
    moved = first[root[first] != first]
    return moved, root[moved]


def proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of likely copies in the groups of a sorted partition, groups whole, in pieces: of
    groups of one block a few for each, of groups of two blocks those that connect parts."""
    names = ("key", "i", "j", "block", "part", "fp", "id")

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        cols = {x: rows[x].to_numpy().astype(np.int64) for x in names}
        signs = np.frombuffer(b"".join(rows["sign"].to_pylist()), np.uint8).reshape(len(rows), -1)
        fresh = np.zeros(len(rows), bool)
        fresh[1:] = np.any([cols[x][1:] != cols[x][:-1] for x in ("key", "i", "j")], axis=0)
        group, fps, ids = np.cumsum(fresh), cols["fp"].view(np.uint64), cols["id"]
        if (cols["i"] == cols["j"]).all():
            one, other, share = partners(group, fps, signs)
        else:
            one, other = bridges(group, cols["block"], cols["part"], fps, signs)
            share = np.zeros(len(one))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.maximum(ids[one], ids[other])), pa.array(np.minimum(ids[one], ids[other])), pa.array(share)],
            names=["a", "b", "share"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(x).to_numpy() for x in ("key", "i", "j")]
        same = np.all([k == k[-1] for k in keys], axis=0)
        start = 0 if same.all() else batch.num_rows - int(same[::-1].argmin())
        if start or (held and any(held[-1].column(x)[-1].as_py() != int(k[0]) for x, k in zip(("key", "i", "j"), keys, strict=True))):
            yield pairs([*held, batch.slice(0, start)] if start else held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pairs(held)


PAIRS = "a long, b long, share double"


def choose(pairs: DataFrame) -> DataFrame:
    """``a, b, chosen``: of all keys' ``pairs(a, b, share)``, each once, the best PARTNERS of a set
    on either side are chosen; those with share 0 stay for the connections, the rest goes."""
    once = pairs.groupBy("a", "b").agg(F.max("share").alias("share"), F.min("share").alias("least"))
    for side, other in (("a", "b"), ("b", "a")):
        order = Window.partitionBy(side).orderBy(F.desc("share"), other)
        once = once.withColumn(f"at_{side}", F.row_number().over(order))
    chosen = (F.col("share") > 0) & (F.least("at_a", "at_b") <= PARTNERS)
    return once.select("a", "b", chosen.alias("chosen"), "least").filter(F.col("chosen") | (F.col("least") == 0)).drop("least")


def likely_pairs(sets: DataFrame) -> DataFrame:
    """``a, b, chosen``: pairs of ``sets(id, fp, keys, sign)`` that may be near copies, a few for
    each, and pairs not chosen that keep every connection by likely pairs.

    Sets meet where a min-hash key is equal; only keys and ids are shuffled to find where, and
    sketches follow the ids that meet any. A key with more than BLOCK sets is dealt to blocks,
    compared each by itself first. What connects its blocks is then looked for in two steps:
    one set of each part of the key, and last all sets of different parts, block by block. A
    crowd is one part before the last step, so the pairs of a set do not grow with its group.
    """
    keyed = sets.select(F.explode("keys").alias("key"), "id")
    groups = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "copies-keys")
    sketched = sets.select("id", "fp", "sign")

    def dealt(rows: DataFrame) -> DataFrame:
        """``rows(key, i, j, block, part, id)`` with their sketches, compared."""
        met = rows.join(sketched, "id").select("key", "i", "j", "block", "part", "fp", "id", "sign")
        return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(proposed, PAIRS)

    def block(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.ceil(F.col(n) / BLOCK)).alias("block")

    def alone(rows: DataFrame) -> DataFrame:
        """Each block of ``rows(key, id, n)`` by itself."""
        return rows.select("key", "id", block("n")).select(
            "key", F.col("block").alias("i"), F.col("block").alias("j"), "block", F.col("id").alias("part"), "id")

    found = stored(choose(dealt(alone(keyed.join(groups, "key")))), "copies-likely")
    large = groups.filter(F.col("n") > BLOCK)
    if large.isEmpty():
        return found
    crowded = stored(keyed.join(large, "key"), "copies-crowded")

    def parted() -> DataFrame:
        """``crowded`` with the part of each set by the pairs found so far."""
        parts = contracted(found.select("a", "b"), "copies-coarse").select(F.col("v").alias("id"), F.col("root").alias("part"))
        return stored(crowded.join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "copies-crowded")

    places = parted()
    while True:
        heads = places.groupBy("key", "part").agg(F.min("id").alias("id"))
        several = stored(heads.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "copies-several")
        if several.isEmpty():
            return found
        fresh = stored(choose(dealt(alone(heads.select("key", "id").join(several, "key")))), "copies-likely")
        found = found.union(fresh)
        before, places = places.select("part").distinct().count(), parted()
        if several.filter(F.col("n") > BLOCK).isEmpty() or places.select("part").distinct().count() == before:
            break
    placed = places.select("key", "id", "part", block("n"))
    blocks = stored(placed.groupBy("key", "block").agg(F.min("part").alias("low"), F.max("part").alias("high")), "copies-blocks")
    one, other = (blocks.select("key", F.col("block").alias(b), F.col("low").alias(f"low_{b}"), F.col("high").alias(f"high_{b}")) for b in ("i", "j"))
    apart = (F.col("low_i") != F.col("high_i")) | (F.col("low_j") != F.col("high_j")) | (F.col("low_i") != F.col("low_j"))
    across = one.join(other, (one["key"] == other["key"]) & (F.col("i") < F.col("j")) & apart).select(
        one["key"], "i", "j", F.explode(F.array("i", "j")).alias("block"))
    return found.union(stored(choose(dealt(placed.join(across, ["key", "block"]))), "copies-likely"))


def gram_sets(text: Column) -> Column:
    """The sorted set of five-word shingle hashes as bytes."""
    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.unique(shingle_hashes(t, WIDE)).tobytes() for t in texts], dtype=object)

    return of(text)


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each set of ``left`` has in common with each of ``right``."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    often = times[column] > 1
    row, column = row[often], number[column[often]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)))
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        low, high = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        both += part[left] @ part[right].T
    return both


def missed_links(sets: DataFrame, coarse: DataFrame, found: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a, b``: links between parts of ``found(v, root)`` that similar texts of one ``coarse`` group connect.

    Whatever likely pairs connect is one coarse group. Of the groups that are not one part yet,
    all texts of different parts are compared by their whole sets: parts are put in blocks of
    about BLOCK sets, larger parts in blocks of their own, and each pair of blocks is a task.
    """
    inside = sets.select("id").join(coarse.select(F.col("v").alias("id"), F.col("root").alias("near")), "id").join(
        found.select(F.col("v").alias("id"), F.col("root").alias("part")), "id", "left").withColumn("part", F.coalesce("part", "id"))
    inside = stored(inside, "copies-inside")
    apart = stored(inside.groupBy("near").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("near"), "copies-apart")
    unsettled = stored(inside.join(apart, "near", "left_semi"), "copies-unsettled")
    wanted = texts.join(unsettled.select("id"), "id", "left_semi").dropDuplicates(["id"])
    grams = unsettled.join(wanted.select("id", gram_sets(F.col("text")).alias("grams")), "id")
    weight = F.greatest(F.lit(1.0), F.length("grams") / (8 * HEAVY))
    grams = stored(grams.withColumn("weight", weight), "copies-grams")
    parts = grams.groupBy("near", "part").agg(F.sum("weight").alias("size")).withColumn("large", F.col("size") >= BLOCK)
    parts = stored(parts, "copies-parts")
    small = parts.filter(~F.col("large")).groupBy("near").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"))
    sized = parts.join(small, "near", "left").select("near", "part", "large", F.when(F.col("large"), F.ceil(F.col("size") / BLOCK)).otherwise(F.col("blocks")).alias("blocks"))
    block = F.when(F.col("large"), F.xxhash64("part", F.pmod(F.xxhash64("id"), "blocks"))).otherwise(F.pmod(F.xxhash64("part"), "blocks"))
    dealt = stored(grams.join(sized, ["near", "part"]).select(
        "near", "part", "id", "grams", block.alias("block"), F.when(F.col("large"), F.col("part")).alias("whole")), "copies-blocks")
    blocks = stored(dealt.select("near", "block", "whole").distinct(), "copies-block-list")
    one, other = (blocks.select("near", F.col("block").alias(b), F.col("whole").alias(w)) for b, w in (("i", "_one"), ("j", "_other")))
    met = one.join(other, (one.near == other.near) & (one.i <= other.j) & F.coalesce(F.col("_one") != F.col("_other"), F.lit(True)))
    met = met.select(one.near, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))

    def linked(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        names, part = np.unique(rows["part"].to_numpy(), return_inverse=True)
        block = rows["block"].to_numpy()
        left, right = (np.flatnonzero(block == rows[x][0].as_py()) for x in ("i", "j"))
        held = [np.frombuffer(g, np.uint64) for g in rows["grams"].to_pylist()]
        size = np.array([len(g) for g in held])
        both = shared(held, left, right)
        alike = both / np.maximum(1, size[left][:, None] + size[right] - both) >= least
        x, y = np.nonzero(alike & (part[left][:, None] != part[right]))
        root = np.arange(len(names))
        united(root, part[left[x]], part[right[y]])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[root[moved]]})

    rows = dealt.drop("whole").join(met, ["near", "block"])
    return rows.groupBy("near", "i", "j").applyInArrow(linked, "a long, b long")


def keep_one(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``docs`` with one row, that of the smallest id, of each group of near copies.

    Texts are near copies if their sets of five-word shingles have a similarity of ``least`` or
    more; groups are closed under the links found. Candidates are linked SimHash fingerprints
    and, since at this similarity fingerprints differ in more bits than any table of them can
    afford, likely pairs under equal min-hash keys: first a few partners of each text, then all
    texts that likely pairs connect and that are of different groups still; whole texts decide.
    Texts without words are copies of each other, as are rows that repeat an id. Rows without id go by their text, behind all ids.
    """
    ship_package(docs.sparkSession)
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn("_llm_key", F.coalesce(F.col("doc_id").cast("long"), by_text))
    marked = stored(keyed.select(F.col("_llm_key").alias("id"), sketches(F.col("text")).alias("s")).select("id", "s.*"), "copies-marks")
    sets = stored(
        marked.groupBy("content").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sign").alias("sign")),
        "copies-sets")
    values = stored(sets.groupBy("fp").agg(F.min("id").alias("id")), "copies-values")
    one, other = (values.select(F.col("fp").alias(x), F.col("id").alias(f"id_{x}")) for x in ("a", "b"))
    near = links(values.select("fp")).join(one, "a").join(other, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    same = sets.join(values.withColumnRenamed("id", "b"), "fp").filter("id <> b").select(F.col("id").alias("a"), "b")
    likely = likely_pairs(sets)
    pairs = stored(likely.filter("chosen").select("a", "b").union(near).union(same).distinct(), "copies-pairs")
    texts = keyed.select(F.col("_llm_key").alias("id"), "text")
    alike = stored(verified(pairs, texts, least), "copies-alike")
    coarse = contracted(likely.select("a", "b").union(pairs), "copies-near")
    missed = stored(missed_links(sets, coarse, contracted(alike, "copies-parts"), texts, least), "copies-missed")
    joined = contracted(alike.union(missed).union(
        marked.join(sets.select("content", F.col("id").alias("first")), "content").filter("id <> first").select(F.col("id"), F.col("first"))),
        "copies-groups")
    dropped = stored(joined.filter("root <> v").select(F.col("v").alias("_llm_key")), "copies-dropped")
    return keyed.join(dropped, "_llm_key", "left_anti").dropDuplicates(["_llm_key"]).drop("_llm_key")
