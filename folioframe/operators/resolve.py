"""Duplicates and identities.

Set similarity is exact: two token sets of Jaccard >= t must share a token among the rarest
``n - ceil(t n) + 1`` of each, so records meet on those tokens only and are then verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import ids
from folioframe.functions import text as X
from folioframe.functions.scores import r6
from folioframe.session import cut_lineage


# -- record identity ----------------------------------------------------------------------


def with_identity(records: DataFrame, title: str = "title", year: str = "year") -> DataFrame:
    """Adds ``identity``, built from cleaned identifiers."""
    return records.withColumn(
        "identity",
        ids.identity_key(ids.doi(F.col("doi")), ids.arxiv(F.col("arxiv_id")), ids.pmid(F.col("pmid")),
                         F.col("provider"), F.col("provider_id"), F.col(title), F.col(year)),
    )


def dedup_first(records: DataFrame, key: str = "identity", arrival: str = "arrival") -> DataFrame:
    """First arrival of each key; copies are reduced before the shuffle."""
    others = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.min_by(F.struct(*others), F.col(arrival)).alias("r")).select(key, "r.*")


# fixed values: identifier kinds, strongest first
ID_ORDER = ("doi", "arxiv", "openalex", "semantic_scholar", "pmid", "crossref", "key")


def identifiers(records: DataFrame, id_col: str) -> DataFrame:
    """``record, priority, kind, value``: every valid identifier of every record."""
    provider = F.col("provider")
    values = {
        "doi": ids.doi(F.col("doi")), "arxiv": ids.arxiv(F.col("arxiv_id")), "pmid": ids.pmid(F.col("pmid")),
        "openalex": F.when(provider == "openalex", ids.openalex(F.col("provider_id"))),
        "semantic_scholar": F.when(provider == "semantic_scholar", X.blank_to_null(F.col("provider_id"))),
        "crossref": F.when(provider == "crossref", X.blank_to_null(F.col("provider_id"))),
        "key": F.col("identity"),
    }
    rows = F.filter(
        F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), values[k].alias("value")) for i, k in enumerate(ID_ORDER)]),
        lambda s: s["value"].isNotNull(),
    )
    return records.select(F.col(id_col).alias("record"), F.inline_outer(rows)).filter("value IS NOT NULL")


def find_duplicates(incoming: DataFrame, store: DataFrame, id_col: str = "arrival") -> DataFrame:
    """``record, match, kind``: the stored record found by the strongest shared identifier.

    The store keeps one record per identifier before the join, so an identifier on a third of
    all records still joins as one row.
    """
    held = identifiers(store, id_col).groupBy("kind", "value").agg(F.min("record").alias("match"))
    hit = identifiers(incoming, id_col).join(held, ["kind", "value"])
    best = hit.groupBy("record").agg(F.min(F.struct("priority", "match", "kind")).alias("b"))
    return best.select("record", F.col("b.match").alias("match"), F.col("b.kind").alias("kind"))


def upsert_papers(incoming: DataFrame, store: DataFrame, id_col: str = "arrival") -> tuple[DataFrame, DataFrame]:
    """The store with new papers appended, and ``record, action`` for every incoming one."""
    first = dedup_first(incoming, "identity", id_col)
    known = find_duplicates(first, store, id_col)
    new = first.join(known.select(F.col("record").alias(id_col)), id_col, "left_anti")
    # Records of one batch that share an identifier, be it through others, are one paper.
    shared = identifiers(new, id_col).select("record", F.concat_ws(":", "kind", "value").alias("value"))
    later = resolve_entities(shared).filter("record <> entity").select(F.col("record").alias(id_col))
    fresh = new.join(later, id_col, "left_anti")
    merged = store.unionByName(fresh, allowMissingColumns=True)
    made = fresh.select(F.col(id_col).alias("record"), F.lit("created").alias("made"))
    actions = incoming.select(F.col(id_col).alias("record")).join(made, "record", "left").select(
        "record", F.coalesce("made", F.lit("duplicate")).alias("action"))
    return merged, actions


def resolve_entities(links: DataFrame) -> DataFrame:
    """``record, entity``: records connected through shared identifier values, transitively.

    Each round takes the least label over every identifier, then over every record, then jumps
    to the label of the label. Both steps are aggregations, so a value shared by very many
    records costs one partial result per task. Ends when nothing changes. The joins are merge
    joins: tables just under the threshold would be broadcast anew in every round, and the driver
    holds each of them until it next collects garbage.
    """
    pairs = cut_lineage(links.select("record", "value").distinct())
    labels = cut_lineage(pairs.select("record", F.col("record").alias("entity")).distinct())
    while True:
        per_value = pairs.join(labels.hint("merge"), "record").groupBy("value").agg(F.min("entity").alias("entity"))
        per_record = pairs.join(per_value.hint("merge"), "value").groupBy("record").agg(F.min("entity").alias("near"))
        hop = labels.select(F.col("record").alias("near"), F.col("entity").alias("far"))
        moved = per_record.join(hop.hint("merge"), "near", "left").select("record", F.least("near", "far").alias("entity"))
        fresh = cut_lineage(moved)
        changed = fresh.join(labels.withColumnRenamed("entity", "old").hint("merge"), "record").filter("entity <> old").limit(1).count()
        labels = fresh
        if not changed:
            return labels


# -- authors ------------------------------------------------------------------------------


def _left_join_known(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; rows without it, which match nothing, would all be dealt to one task."""
    met = left.filter(F.col(key).isNotNull()).join(right, key, "left")
    rest = left.filter(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in right.schema if f.name != key})
    return met.unionByName(rest)


def sync_authors(incoming: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Author table and ordered links after taking over the authors of papers.

    ``incoming``: ``paper_id, position, name, orcid, affiliation``; ``authors``: ``author_id,
    name, orcid, affiliation``. Identity is the ORCID, else the case-folded name; stored values
    are never overwritten, only nulls are filled with the first known value.
    """
    cleaned = incoming.select(
        "paper_id", "position", F.trim("name").alias("name"), F.nullif(F.lower(F.trim("orcid")), F.lit("")).alias("orcid"),
        F.nullif(F.trim("affiliation"), F.lit("")).alias("affiliation"),
    ).filter(F.length("name") > 0).withColumn("folded", F.lower("name"))
    at = F.struct("paper_id", "position")

    def first_of(value: str, when: Column) -> Column:
        return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), when))

    # One row for each spelling of a person, far fewer than rows of papers: only these are joined.
    spelled = cut_lineage(cleaned.groupBy("folded", "orcid").agg(
        F.min(at).alias("at"), F.min_by("name", at).alias("name"),
        F.min(F.when(F.col("affiliation").isNotNull(), at)).alias("placed_at"), first_of("affiliation", at).alias("affiliation")))
    by_orcid = spelled.filter("orcid IS NOT NULL").groupBy("orcid").agg(F.min_by("folded", "at").alias("orcid_name"))
    keyed = _left_join_known(spelled, by_orcid, "orcid").withColumn("key", F.coalesce("orcid_name", "folded")).drop("orcid_name")
    people = keyed.groupBy("key").agg(
        F.min_by("name", "at").alias("in_name"), first_of("orcid", F.col("at")).alias("in_orcid"), F.min_by("affiliation", "placed_at").alias("in_affiliation"))
    stored_orcid = authors.filter("orcid IS NOT NULL").groupBy(F.lower("orcid").alias("in_orcid")).agg(F.min("author_id").alias("by_orcid"))
    stored_name = authors.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("author_id").alias("by_name"))
    matched = _left_join_known(people, stored_orcid, "in_orcid").join(stored_name, "key", "left").withColumn(
        "match", F.coalesce("by_orcid", "by_name"))
    fill = matched.filter("match IS NOT NULL").groupBy(F.col("match").alias("author_id")).agg(
        F.min_by("in_orcid", F.when(F.col("in_orcid").isNotNull(), F.col("key"))).alias("f_orcid"),
        F.min_by("in_affiliation", F.when(F.col("in_affiliation").isNotNull(), F.col("key"))).alias("f_affiliation"))
    kept = authors.join(fill, "author_id", "left").select(
        F.col("author_id").cast("string").alias("author_id"), "name", F.coalesce("orcid", "f_orcid").alias("orcid"),
        F.coalesce("affiliation", "f_affiliation").alias("affiliation"))
    new = matched.filter("match IS NULL").select(
        F.concat(F.lit("new:"), "key").alias("author_id"), F.col("in_name").alias("name"), F.col("in_orcid").alias("orcid"),
        F.col("in_affiliation").alias("affiliation"))
    who = matched.select("key", F.coalesce(F.col("match").cast("string"), F.concat(F.lit("new:"), "key")).alias("author_id"))
    # no ORCID is the empty one here, which no cleaned ORCID is, so that rows without are dealt by name
    mark = F.coalesce("orcid", F.lit("")).alias("mark")
    meant = keyed.join(who, "key").select("folded", mark, "author_id")
    links = cleaned.select("paper_id", "position", "folded", mark).join(meant, ["folded", "mark"]).groupBy(
        "paper_id", "author_id").agg(F.min("position").alias("author_order"))
    return kept.unionByName(new), links


# -- exact and near text copies -----------------------------------------------------------


def text_signature(text: Column) -> Column:
    return F.sha2(X.squeeze(F.lower(text)), 256)


def dedup_exact_text(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``chunk_id, kept, copies``: least id per text (case and blanks ignored).

    Only ids and digests are shuffled, never texts.
    """
    signed = rows.select(id_col, text_signature(F.col("text")).alias("sig"))
    return signed.groupBy("sig").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")).select(id_col, "copies")


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(X.tokens(text)))


def _prefix_length(n: Column, t: float) -> Column:
    # the small step back keeps t * n from landing just above a whole number
    return (n - F.ceil(n * t - 1e-9) + 1).cast("int")


def rare_first(sets: DataFrame, keys: list[str], group: list[str] | None = None) -> DataFrame:
    """Token sets with tokens ordered from rare to common over all sets, or those of a group."""
    flat = sets.select(*keys, F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    near = [*(group or []), "token"]
    df = flat.groupBy(*near).agg(F.count(F.lit(1)).alias("df"))
    ordered = flat.join(df, near).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("o"))
    return ordered.select(*keys, F.col("o.token").alias("tokens"), F.size("o").alias("n"))


# tokens that are ordered by frequency; the rarer ones come first, in the order they stand in
COMMON = 1 << 17


def common_last(sets: DataFrame, keys: list[str], counted: DataFrame) -> DataFrame:
    """As ``rare_first``, over all sets, for sorted ``tokens``: rarest first as far as it matters.

    Any order that all sets share is exact. The COMMON most frequent tokens of ``counted``, which
    are all that the driver holds, are ordered by frequency, the rest by themselves, so each set
    is put in order where its row is read and only the counts of tokens are shuffled. Sets without
    tokens stay.
    """
    words = counted.select(F.explode_outer("tokens").alias("token")).filter("token IS NOT NULL")
    often = words.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").orderBy(F.desc("df"), "token").limit(COMMON)
    shared = sets.sparkSession.sparkContext.broadcast(often.select("token").toArrow()["token"].combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for part in batches:
            lists = part.column("tokens")
            flat = lists.flatten()
            seat = len(common) - pc.fill_null(pc.index_in(flat, common), len(common)).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(lists)), sizes)
            order = np.argsort(row * (len(common) + 1) + seat, kind="stable")
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(k) for k in keys], pa.ListArray.from_arrays(offsets, flat.take(pa.array(order))), pa.array(sizes.astype(np.int32))],
                names=[*keys, "tokens", "n"])

    schema = ", ".join(f"{k} {sets.schema[k].dataType.simpleString()}" for k in keys)
    return sets.select(*keys, "tokens").mapInArrow(run, f"{schema}, tokens array<string>, n int")


def _jaccard(a: str, b: str) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def jaccard_pairs(sets: DataFrame, threshold: float, group: list[str], rank: str, side: Column | None = None) -> DataFrame:
    """Pairs ``a, b`` with Jaccard >= threshold inside a group, ``a`` before ``b`` by ``rank``.

    ``sets``: group columns, ``rank``, ``id``, ``tokens`` (in one global order), ``n``. With
    ``side``, only pairs from different sides. Length and position rule pairs out before the
    token sets are fetched for verification.
    """
    marked = sets.withColumn("side", side if side is not None else F.lit(None).cast("boolean"))
    pieces = marked.select(*group, rank, "id", "n", "side", F.posexplode(F.slice("tokens", 1, _prefix_length(F.col("n"), threshold))).alias("pos", "token"))

    def named(df: DataFrame, tag: str) -> DataFrame:
        return df.select(*group, "token", *[F.col(c).alias(f"{c}_{tag}") for c in dict.fromkeys((rank, "id", "n", "pos", "side"))])

    room = 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    met = named(pieces, "a").join(named(pieces, "b"), [*group, "token"]).filter(
        (F.struct(f"{rank}_a", "id_a") < F.struct(f"{rank}_b", "id_b"))
        & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
        & (room >= threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9)
        & (F.lit(side is None) | (F.col("side_a") != F.col("side_b")))
    ).select(*group, F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    body = sets.select(*group, "id", "tokens")
    full = met.join(body.select(*group, F.col("id").alias("a"), F.col("tokens").alias("ta")), [*group, "a"]).join(
        body.select(*group, F.col("id").alias("b"), F.col("tokens").alias("tb")), [*group, "b"])
    return full.withColumn("similarity", _jaccard("ta", "tb")).filter(F.col("similarity") >= threshold - 1e-9).select(
        *group, "a", "b", r6(F.col("similarity")).alias("similarity"))


# pairs are listed once there are at most this many per open (row, key) entry
PAIRS_PER_ENTRY = 8
# from this threshold on, parts of a set hold enough tokens to be rare
PARTS_FROM = 0.75
# bytes of text that are held as tokens at a time
SLICE = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of them."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _token_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, a weighted sum of its bytes."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]].astype(np.uint64)
    size = np.diff(ends)
    at = (np.arange(len(raw)) - np.repeat(ends[:-1] - ends[0], size)).astype(np.uint64)
    weight = _mixed(at + np.uint64(1)) | np.uint64(1)
    # no word is empty, so every sum has a place of its own
    return _mixed(np.add.reduceat((raw + np.uint64(1)) * weight, ends[:-1] - ends[0]))


def _size_classes(t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, number of parts and of spared empty parts for every class of set sizes.

    Similar sets are of one class or of neighbouring ones. In the class of the larger, at most
    ``d`` tokens are in one of the two sets only.
    """
    least = [1]
    while least[-1] < 1 << 31:
        least.append(max(least[-1] + 1, int(np.ceil(least[-1] / t - 1e-6))))
    largest = np.array(least[1:], np.float64) - 1
    d = np.floor((1 - t) / (1 + t) * 2 * largest + 1e-6).astype(np.int64)
    spared = d // 16
    return np.array(least[:-1], np.int64), d + 1 + spared, spared


def part_keys(hashes: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of token sets, and their number for each: sets of Jaccard >= threshold share one.

    The tokens of a set are dealt to one part more than two similar sets can differ in, so one
    part is the same in both. As sizes decide the number of parts, a set is dealt as the larger
    of a pair for its own class and as the smaller one for the next. Empty parts would be the
    same in many sets: there are some parts more, and a set gives the keys of empty parts only
    when it has more of them than those.
    """
    t = threshold - 1e-8
    least, parts, spared = _size_classes(t)
    own = np.searchsorted(least, sizes, "right") - 1
    ahead = np.flatnonzero(sizes >= t * least[own + 1])
    row = np.concatenate((np.arange(len(sizes)), ahead))
    kind = np.concatenate((own, own[ahead] + 1))
    m = parts[kind]
    first = np.cumsum(m) - m
    start = np.cumsum(sizes) - sizes
    # every token of every dealt set: its place among the hashes, then the place of its part
    n = sizes[row]
    dealt = np.repeat(np.arange(len(row)), n)
    token = hashes[np.arange(len(dealt)) - np.repeat(np.cumsum(n) - n - start[row], n)]
    part = (((token >> np.uint64(32)) * m[dealt].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(int(m.sum()), np.uint64)
    np.add.at(sums, first[dealt] + part, _mixed(token))
    holder = np.repeat(np.arange(len(row)), m)
    number = np.arange(len(sums)) - first[holder]
    empty = sums == 0
    given = ~empty | (np.bincount(holder[empty], minlength=len(row)) > spared[kind])[holder]
    keys = _mixed(sums + _mixed((kind[holder].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)))
    at = row[holder[given]]
    order = np.argsort(at, kind="stable")
    return keys[given][order].astype(np.int64), np.bincount(at, minlength=len(sizes))


def _token_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """``ord, tokens, n, sig, keys`` of lower-case ``text`` in bytes, a slice of rows at a time.

    Texts without tokens have neither digest nor keys.
    """
    blank = bytes.maketrans(b"\n\t\r", b"   ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            size = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            slices = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=-1))
            for a, b in zip(slices, [*slices[1:], len(part)]):
                cut = part.slice(a, b - a)
                sets = [sorted(set((text or b"").translate(blank).split(b" ")) - {b""}) for text in cut.column("text").to_pylist()]
                n = np.array([len(s) for s in sets], np.int64)
                words = pa.array([w for s in sets for w in s], pa.binary())
                keys, number = part_keys(_token_hashes(words), n, threshold) if len(words) else (np.zeros(0, np.int64), n)
                starts = [pa.array(np.concatenate(([0], np.cumsum(x))).astype(np.int32)) for x in (n, number)]
                sig = pa.array([hashlib.sha256(b" ".join(s)).digest() if s else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [cut.column("ord"), pa.ListArray.from_arrays(starts[0], words.view(pa.string())), pa.array(n.astype(np.int32)), sig,
                     pa.ListArray.from_arrays(starts[1], pa.array(keys))], names=["ord", "tokens", "n", "sig", "keys"])

    return rows.mapInArrow(run, f"ord {rows.schema['ord'].dataType.simpleString()}, tokens array<string>, n int, sig binary, keys array<long>")


def _pairs_are_few(open_: DataFrame) -> bool:
    """Whether the pairs that share a key are linear in the number of entries."""
    per = open_.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    row = per.agg(F.sum("c").alias("entries"), F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).first()
    return (row["pairs"] or 0) <= PAIRS_PER_ENTRY * (row["entries"] or 0)


def dedup_near_text(rows: DataFrame, threshold: float = 0.9, id_col: str = "chunk_id") -> DataFrame:
    """``chunk_id, kept_id``: every row with the row that stands for it (itself when kept).

    Rows are taken by score, then id; a row is dropped when it is at least ``threshold`` similar
    to a kept one. A text without tokens is similar to none. Equal token sets are folded first.
    Similar sets share a key (``part_keys``; below PARTS_FROM a rare token), so only keys of
    several sets matter. While too many rows share their keys, each key elects its best open row:
    a row that leads all its keys is certainly kept, and the rows behind it are compared with it
    alone. A group of very many near copies thus costs one comparison per row and key, never all
    pairs. Once the pairs left are few, they are listed and settled in order. Every round decides
    at least the best open row, so no limit on rounds is needed, and the result is the same either
    way. Whole token sets decide, never keys.
    """
    signed = cut_lineage(_token_sets(
        rows.select(F.struct((-F.col("score")).alias("s"), F.col(id_col).alias("i")).alias("ord"), F.lower("text").cast("binary").alias("text")),
        max(threshold, PARTS_FROM)).withColumn("row", F.monotonically_increasing_id()))
    heads = cut_lineage(signed.filter("n > 0").groupBy("sig").agg(F.min(F.struct("ord", "row", "n")).alias("h")).select("sig", "h.*"))
    sets = signed.select("row", "n", "tokens", "keys").join(heads.select("row"), "row")
    if threshold < PARTS_FROM:
        rare = F.slice("tokens", 1, _prefix_length(F.col("n"), threshold))
        sets = common_last(sets, ["row"], signed).withColumn("keys", F.transform(rare, lambda t: F.xxhash64(t)))
    entries = sets.select("row", F.explode("keys").alias("key"))
    several = entries.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("c > 1").drop("c")
    open_ = cut_lineage(several.join(heads.select("row", "ord", "n"), "row"))
    body = cut_lineage(signed.select("row", "tokens").join(open_.select("row").distinct(), "row", "left_semi"))
    alike = F.least("n", "lead_n") >= threshold * F.greatest("n", "lead_n") - 1e-9

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(body.withColumnRenamed("tokens", "t1"), "row").join(
            body.select(F.col("row").alias("lead"), F.col("tokens").alias("t2")), "lead")
        return full.filter(_jaccard("t1", "t2") >= threshold - 1e-9).select("row", "lead", "lead_ord")

    dropped = []
    while not _pairs_are_few(open_):
        best = open_.groupBy("key").agg(F.min(F.struct("ord", "row", "n")).alias("l"))
        seen = open_.join(best, "key").select("row", "n", F.col("l.row").alias("lead"), F.col("l.ord").alias("lead_ord"), F.col("l.n").alias("lead_n"))
        clear = cut_lineage(seen.groupBy("row").agg(F.min(F.col("lead") == F.col("row")).alias("all_led")).filter("all_led").select("row"))
        behind = seen.filter((F.col("lead") != F.col("row")) & alike).join(clear.select(F.col("row").alias("lead")), "lead", "left_semi").select(
            "row", "lead", "lead_ord").distinct()
        dropped.append(cut_lineage(verify(behind).groupBy("row").agg(F.min_by("lead", F.struct("lead_ord", "lead")).alias("kept"))))
        open_ = cut_lineage(open_.join(clear.unionByName(dropped[-1].select("row")), "row", "left_anti"))
    a = open_.select("key", F.col("row").alias("lead"), F.col("ord").alias("lead_ord"), F.col("n").alias("lead_n"))
    met = open_.join(a, "key").filter((F.struct("lead_ord", "lead") < F.struct("ord", "row")) & alike).select("row", "lead", "lead_ord").distinct()
    dropped += _settle_pairs(cut_lineage(verify(met)))
    names = heads.select(F.col("row").alias("kept"), F.col("ord.i").alias("kept_id"))
    fate = dropped[0]
    for more in dropped[1:]:
        fate = fate.unionByName(more)
    stands = heads.select("sig", "row", F.col("ord.i").alias("head_id")).join(fate.join(names, "kept").select("row", "kept_id"), "row", "left").select(
        "sig", F.coalesce("kept_id", "head_id").alias("kept_id"))
    own = F.col("ord.i").alias(id_col)
    return signed.filter("n > 0").select("sig", own).join(stands, "sig").select(id_col, "kept_id").unionByName(
        signed.filter("n = 0").select(own, F.col("ord.i").alias("kept_id")))


def _settle_pairs(pairs: DataFrame) -> list[DataFrame]:
    """``row, kept`` of the rows that a greedy choice drops: a row is kept once all better
    neighbours are dropped. ``pairs``: ``row, lead, lead_ord``."""
    dropped = []
    while True:
        worse = pairs.select("row").distinct()
        free = pairs.select(F.col("lead").alias("row")).distinct().join(worse, "row", "left_anti")
        drop = cut_lineage(pairs.join(free.select(F.col("row").alias("lead")), "lead", "left_semi").groupBy("row").agg(
            F.min_by("lead", F.struct("lead_ord", "lead")).alias("kept")))
        dropped.append(drop)
        gone = drop.select("row")
        # a dropped row stands in nobody's way, and what is kept has dropped all its neighbours
        pairs = cut_lineage(pairs.join(gone, "row", "left_anti").join(gone.select(F.col("row").alias("lead")), "lead", "left_anti"))
        if pairs.isEmpty():
            return dropped


def fold_sets(rows: DataFrame, group: list[str], id_col: str, tokens: Column) -> DataFrame:
    """Rows with equal token sets in a group folded into one: least id and number of copies.

    Tokens come rarest of the group first, so that sets meet on few tokens.
    """
    flat = rows.select(*group, F.col(id_col).alias("id"), F.sort_array(tokens).alias("tokens"))
    folded = flat.groupBy(*group, "tokens").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    keys = [*group, "id"]
    ordered = rare_first(folded, keys, group)
    return folded.drop("tokens").join(ordered, keys, "left").withColumns(
        {"tokens": F.coalesce("tokens", F.array().cast("array<string>")), "n": F.coalesce("n", F.lit(0))})


def pairwise_jaccard(rows: DataFrame, threshold: float = 0.9, group: str = "query_id", id_col: str = "chunk_id") -> DataFrame:
    """Duplicate pairs, their share and the diversity per group.

    Pairs of equal sets follow from counts; only unequal similar sets are joined. Both the rows'
    sets and the folded ones are used several times and written once.
    """
    sets = cut_lineage(rows.select(group, id_col, X.word_set(F.col("text")).alias("tokens")))
    folded = cut_lineage(fold_sets(sets, [group], id_col, F.col("tokens")))
    close = jaccard_pairs(folded, threshold, [group], "id")
    copies = folded.select(group, "id", "copies")
    across = close.join(copies.select(group, F.col("id").alias("a"), F.col("copies").alias("ca")), [group, "a"]).join(
        copies.select(group, F.col("id").alias("b"), F.col("copies").alias("cb")), [group, "b"]
    ).groupBy(group).agg(F.sum(F.col("ca") * F.col("cb")).alias("across"))
    base = folded.groupBy(group).agg(
        F.sum("copies").alias("items"), F.sum(F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("within"))
    pairs = F.col("within") + F.coalesce("across", F.lit(0))
    total = F.col("items") * (F.col("items") - 1) / 2
    share = F.when(total == 0, 0.0).otherwise(pairs / total)
    return base.join(across, group, "left").select(
        group, "items", pairs.alias("duplicate_pairs"), r6(share).alias("duplicate_ratio"), r6(1.0 - share).alias("diversity"))


def prefix_diversity(rows: DataFrame, group: str = "query_id", id_col: str = "chunk_id", length: int = 50) -> DataFrame:
    """Distinct openings over items; an empty text is its own opening."""
    opening = F.array_join(F.slice(X.tokens(F.col("text")), 1, length), " ")
    sign = F.when(opening == "", F.concat(F.lit("empty:"), F.col(id_col).cast("string"))).otherwise(opening)
    return rows.select(group, F.xxhash64(sign).alias("sign")).groupBy(group).agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("sign").alias("openings")
    ).withColumn("diversity", F.when(F.col("items") <= 1, 1.0).otherwise(r6(F.col("openings") / F.col("items"))))


# -- sources and references ---------------------------------------------------------------


def unique_sources(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per source identity: its first mention and the evidence of all its mentions.

    ``sources``: ``position, id, paper_id, document_id, title, source_type``; ``evidence``:
    ``source_id``. Evidence is counted per id before it is joined.
    """
    counts = evidence.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence_count"))
    keyed = sources.join(counts, "id", "left").withColumn(
        "identity", ids.source_identity(F.col("paper_id"), F.col("document_id"), F.col("id"), F.col("title"), F.col("source_type")))
    return keyed.groupBy("identity").agg(
        F.min_by(F.struct("id", "title"), "position").alias("first"), F.count(F.lit(1)).alias("mentions"),
        F.sum(F.coalesce("evidence_count", F.lit(0))).alias("evidence_count"),
    ).select("identity", F.col("first.id").alias("source_id"), F.col("first.title").alias("title"), "mentions", "evidence_count")


def reference_identity(paper_id: Column, document_id: Column, title: Column, authors: Column, year: Column, kind: Column, source_id: Column) -> Column:
    def text(c: Column) -> Column:
        return F.lower(X.squeeze(F.coalesce(c, F.lit(""))))

    return F.coalesce(
        F.concat(F.lit("paper:"), paper_id.cast("string")),
        F.concat(F.lit("document:"), F.lower(F.nullif(document_id.cast("string"), F.lit("")))),
        F.when(text(title) != "", F.concat(
            F.lit("title:"), text(title), F.lit("|authors:"), F.array_join(F.transform(authors, lambda a: F.lower(X.squeeze(a))), "|"),
            F.lit("|year:"), F.coalesce(year.cast("string"), F.lit("")), F.lit("|source:"), text(kind))),
        F.concat(F.lit("source:"), F.lower(source_id.cast("string"))),
    )


def unique_references(citations: DataFrame, evidence: DataFrame, group: str) -> DataFrame:
    """Numbered bibliography of each report with the evidence behind every entry.

    Both inputs carry ``group`` and ``identity``; ``citations`` also ``position`` and ``title``.
    """
    from pyspark.sql import Window

    entries = citations.groupBy(group, "identity").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title"))
    counts = evidence.groupBy(group, "identity").agg(F.count(F.lit(1)).alias("evidence_count"))
    number = F.row_number().over(Window.partitionBy(group).orderBy("position", "identity"))
    return entries.join(counts, [group, "identity"], "left").fillna(0, ["evidence_count"]).select(
        group, "identity", "title", number.alias("number"), "evidence_count")


def unique_citations(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """First mention of every source some evidence refers to."""
    used = sources.join(evidence.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
    return dedup_first(used, "id", "position")
