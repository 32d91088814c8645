"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers, with
zstandard's own checksum), then a skippable frame with the document ids, then the seek table of
the seekable format: for each frame its compressed size, its plain size and the low 32 bits of
the XXH64 of its plain bytes. Any zstandard tool can decompress the whole file; a reader that
wants a few documents reads the table and then only their frames.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import folder, stored
from folioframe.session import ship_package

# Fixed values of the seekable format.
SKIPPABLE, TABLE, FOOTER, CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
NO_ID = -(1 << 63)
LEVEL = 3
TOGETHER, REMEMBERED = 256, 200_000
STOPS = (".", ",")
ENCODED = "doc_id long, n_tokens long, plain long, checksum long, frame binary"
WRITTEN = "part long, path string, documents long, tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, path string, frame long"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints,
    else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return dict(zip([*shown, *sorted(set(range(256)) - set(shown))], [*shown, *range(256, 324)], strict=True))


def cuts_at_spaces(vocabulary: str) -> bool:
    """Whether a vocabulary lowers letters one by one, drops white space and takes runs of
    letters whole, so that no rule of it looks across a space."""
    with open(vocabulary, encoding="utf-8") as file:
        rules = json.load(file)
    steps = [x.get("type") for x in (rules.get("normalizer") or {}).get("normalizers", [])]
    split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"]
        and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"]
        and "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split[0]["pattern"].get("Regex", ""))


class Encoder:
    """Ids of whole texts.

    Where the vocabulary's rules never look across a space, a text's ids are those of its
    pieces in a row, and pieces that come again are not encoded again: a single stop or comma
    behind a letter or digit is a token of its own, and a piece of small Latin letters alone
    goes to the model as it is. Pieces are remembered in two generations of bounded size;
    those in use move on to the next. Other vocabularies encode each text as a whole.
    """

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.by_piece = cuts_at_spaces(vocabulary)
        self.letters = byte_letters()
        self.end = np.array([end_id], "<u4").tobytes()
        self.known: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def letters_only(self, piece: str) -> str | None:
        """A piece of small Latin letters as the model sees it."""
        if not (piece.isalpha() and piece.islower() and latin(piece)):
            return None
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)

    def learn(self, pieces: set[str]) -> None:
        """Make sure that all of ``pieces`` are known."""
        known, former, tokenize = self.known, self.former, self.tokenizer.model.tokenize
        fresh = []
        for piece in pieces:
            if (data := former.get(piece)) is not None:
                known[piece] = data
            elif (word := self.letters_only(piece)) is not None:
                ids = [token.id for token in tokenize(word)]
                known[piece] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                fresh.append(piece)
        if fresh:
            for piece, encoded in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
                known[piece] = struct.pack(f"<{len(encoded)}I", *encoded.ids)

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids with the end id, as bytes."""
        if not self.by_piece:
            whole = self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(x.ids, "<u4").tobytes() + self.end for x in whole]
        if len(self.known) > REMEMBERED:
            self.former, self.known = self.known, {}
        pieces = [lowered(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        known = self.known
        fresh = set().union(*pieces).difference(known)
        ended = {p for p in fresh if p[-1:] in STOPS and p[-2:-1].isalnum() and latin(p[-2])}
        self.learn((fresh - ended | {p[:-1] for p in ended} | set(STOPS)).difference(known))
        for piece in ended:
            known[piece] = known[piece[:-1]] + known[piece[-1]]
        return [b"".join(map(known.__getitem__, own)) + self.end for own in pieces]


def latin(text: str) -> bool:
    """Whether all characters are below 256; these are composed, and lower alike everywhere."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def lowered(text: str) -> str:
    """A Latin text in lower case, as the vocabulary has it anyway, unless that could make a
    special token of it."""
    return text.lower() if "<|" not in text and latin(text) else text


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """One encoder in each worker process; tasks that follow each other share what it knows."""
    key = vocabulary, end_id
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, end_id)
    return _encoders[key]


def encode(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """One zstandard frame per row of ``docs(doc_id, text)``; a null text counts as empty."""
    ship_package(docs.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(vocabulary, end_id), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                plain = encoder.of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in plain], pa.int64()),
                    pa.array([len(x) for x in plain], pa.int64()),
                    pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in plain], pa.int64()),
                    pa.array(list(map(packer.compress, plain)), pa.binary())],
                    names=["doc_id", "n_tokens", "plain", "checksum", "frame"])

    return docs.select("doc_id", "text").mapInArrow(frames, ENCODED)


def write_file(path: str, rows: Iterable[tuple[int | None, int, int, bytes]]) -> int:
    """Write (doc_id, plain size, checksum, frame) rows as one file; the number of frames."""
    system, place = pyarrow.fs.FileSystem.from_uri(path)
    ids, entries = [], []
    with system.open_output_stream(place, compression=None) as out:
        for doc_id, plain, checksum, frame in rows:
            out.write(frame)
            ids.append(NO_ID if doc_id is None else doc_id)
            entries.append((len(frame), plain, checksum))
        index = np.array(ids, "<i8").tobytes()
        out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = np.array(entries, "<u4").reshape(-1, 3).tobytes()
        out.write(struct.pack("<II", TABLE, len(table) + 9) + table + struct.pack("<IBI", len(entries), CHECKED, FOOTER))
    return len(entries)


class FrameFile:
    """Random access to one file; reads its tables, then only the frames asked for."""

    def __init__(self, path: str):
        system, place = pyarrow.fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != FOOTER or flags != CHECKED:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * n
        self.entries = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3)
        ids_at = at - 8 - 8 * n
        self.ids = np.frombuffer(self.file.read_at(8 * n, ids_at), "<i8")
        self.starts = np.concatenate(([0], np.cumsum(self.entries[:, 0].astype(np.int64))))
        if self.starts[-1] + 8 != ids_at:
            raise ValueError(f"{path}: sizes in the seek table do not add up")
        self.unpacker = zstandard.ZstdDecompressor()

    def plain(self, frame: int) -> bytes:
        size, plain, checksum = map(int, self.entries[frame])
        ids = self.unpacker.decompress(self.file.read_at(size, int(self.starts[frame])), max_output_size=plain)
        if len(ids) != plain or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {frame} does not match its checksum")
        return ids

    def __len__(self) -> int:
        return len(self.entries)


def write(encoded: DataFrame, place: str | None = None) -> DataFrame:
    """Write ``encoded`` frames in ascending order of document id; the manifest, a row per file.

    Each task writes one file under a name of its own and reports it; a file of a task that was
    lost or ran twice is in no manifest. Null ids come first; rows of one id follow each other
    in the order of their checksums.
    """
    spark = encoded.sparkSession
    place = place or folder(spark, "token-frames")
    order = [F.asc_nulls_first("doc_id"), "checksum", "plain"]
    dealt = encoded.repartitionByRange(*order).sortWithinPartitions(*order)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = 0, TaskContext.get().partitionId()
        path = f"{place}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        filled = (b for b in batches if b.num_rows)
        first = next(filled, None)
        if first is None:
            return
        system, local = pyarrow.fs.FileSystem.from_uri(place)
        system.create_dir(local, recursive=True)

        def rows() -> Iterator[tuple]:
            nonlocal tokens
            for batch in chain([first], filled):
                columns = [batch.column(x).to_pylist() for x in ("doc_id", "plain", "checksum", "frame")]
                tokens += sum(columns[1]) // 4
                yield from zip(*columns, strict=True)

        n = write_file(path, rows())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([path]), pa.array([n]), pa.array([tokens])], names=["part", "path", "documents", "tokens"])

    return stored(dealt.mapInArrow(files, WRITTEN), "token-manifest")


def read_all(manifest: DataFrame) -> DataFrame:
    """Every document of the files, from the files: where it starts, its length, its digest.

    ``start`` counts the ids of all documents before it; the sum over files runs over the
    manifest, which has one row per file.
    """
    ship_package(manifest.sparkSession)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("part", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = FrameFile(path)
                for at in range(0, len(file), 4096):
                    frames = range(at, min(at + 4096, len(file)))
                    digests, sizes = [], []
                    for frame in frames:
                        plain = file.plain(frame)
                        digests.append(zlib.crc32(plain))
                        sizes.append(len(plain) // 4)
                    starts = start + np.cumsum([0, *sizes])
                    start = int(starts[-1])
                    ids = file.ids[at:at + len(frames)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids, mask=ids == NO_ID), pa.array(starts[:-1]), pa.array(sizes, pa.int64()), pa.array(digests, pa.int64()),
                        pa.array([path] * len(frames)), pa.array(list(frames), pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "path", "frame"])

    # A row is few bytes but a whole file to read: a task each, not as many as their bytes ask for.
    return placed.repartition(max(1, manifest.count()), "part").mapInArrow(documents, READ)


def read_some(listing: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the rows of ``listing(doc_id, path, frame)``; no other frame is read."""
    ship_package(listing.sparkSession)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            found = []
            for wanted, frame in zip(batch.column("path").to_pylist(), batch.column("frame").to_pylist(), strict=True):
                if wanted != path:
                    path, file = wanted, FrameFile(wanted)
                found.append(np.frombuffer(file.plain(frame), "<u4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    tasks = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = listing.select("doc_id", "path", "frame").repartition(tasks, "path").sortWithinPartitions("path", "frame")
    return dealt.mapInArrow(ids, "doc_id long, ids array<long>")


def token_frames(docs: DataFrame, vocabulary: str, end_id: int = 1, place: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)``, write the files, read them back.

    One row per row of ``docs``: ``doc_id, start, n_tokens, ids_crc32, path, frame``. A null or
    empty text has the end id alone; an empty table writes no file and gives no rows.
    """
    encoded = stored(encode(docs, vocabulary, end_id), "token-ids")
    return read_all(write(encoded, place))
