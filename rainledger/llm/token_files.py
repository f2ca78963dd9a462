"""Token files: independent zstandard frames, a trailing seek table and a checksum per frame.

Documents are ranged and sorted by id; each task encodes its range and writes one file. A file is

* data frames: the ids of all its documents as one stream of little-endian unsigned 32-bit integers,
  cut every ``FRAME_IDS`` ids, each cut compressed as a zstandard frame of its own;
* one more such frame with the index: ids and token counts of the documents in order, as an Arrow stream;
* a seek table in the public layout of seekable zstandard files (a skippable frame that decoders pass
  over): compressed size, size and checksum (lower half of XXH64) of each frame, then the frame count.

As frames hold equally many ids, the place of a document's first id gives its first frame, and a
reader decompresses only the frames of the documents it is asked for.

Each file is written under a temporary name and renamed when complete, and its bytes depend on its
rows alone, so a task that runs again replaces the file by an equal one.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.shared import shared_folder, stored
from .columns import col
from .tokens import encoder
from .units import slices

#: Ids in a frame.
FRAME_IDS = 1 << 16
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


class TokenFileWriter:
    """Writes one token file to a binary stream; holds one frame of ids and the index."""

    def __init__(self, sink, level: int = 3) -> None:
        import zstandard

        self.sink, self.pending, self.entries = sink, bytearray(), []
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.doc_ids: list = []
        self.counts: list[int] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.pending += ids
        size = 4 * FRAME_IDS
        full = len(self.pending) // size * size
        if full:
            with memoryview(self.pending) as view:
                for at in range(0, full, size):
                    self._frame(bytes(view[at:at + size]))
            del self.pending[:full]

    def _frame(self, data: bytes) -> None:
        from xxhash import xxh64_intdigest

        packed = self.compress(data)
        self.sink.write(packed)
        self.entries.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self, id_type) -> int:
        """Writes the last frames and the seek table; the number of ids in the file."""
        import struct

        import pyarrow as pa

        if self.pending:
            self._frame(bytes(self.pending))
        index = pa.table({"doc_id": pa.array(self.doc_ids, id_type), "n_tokens": pa.array(self.counts, pa.int64())})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, index.schema) as writer:
            writer.write_table(index)
        self._frame(out.getvalue().to_pybytes())
        table = b"".join(struct.pack("<3I", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<2I", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        return sum(self.counts)


class TokenFileReader:
    """Reads a token file from a seekable binary stream, frame by frame."""

    def __init__(self, source, size: int) -> None:
        import struct
        from itertools import accumulate

        import pyarrow as pa

        self.source = source
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a token file: its seek table is missing")
        head = size - 9 - 12 * frames - 8
        marks = self._at(head, 8 + 12 * frames)
        if struct.unpack_from("<2I", marks) != (SKIPPABLE_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.entries = list(struct.iter_unpack("<3I", marks[8:]))
        self.starts = [0, *accumulate(e[0] for e in self.entries)]
        if self.starts[-1] != head:
            raise ValueError("the seek table does not fit the file")
        self.index = pa.ipc.open_stream(self.frame(frames - 1)).read_all()

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        """The checked content of a frame."""
        import zstandard
        from xxhash import xxh64_intdigest

        packed, size, checksum = self.entries[k]
        data = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=size)
        if len(data) != size or xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def documents(self, wanted: Collection | None = None) -> Iterator[tuple[object, int, int, Iterator[bytes]]]:
        """(id, start, tokens, pieces of ids) of all documents, or those with a wanted id."""
        held, data, start = -1, b"", 0
        for doc_id, count in zip(self.index["doc_id"].to_pylist(), self.index["n_tokens"].to_pylist()):
            if wanted is None or doc_id in wanted:
                def pieces(start=start, end=start + count):
                    nonlocal held, data
                    for k in range(start // FRAME_IDS, -(-end // FRAME_IDS)):
                        if k != held:
                            held, data = k, self.frame(k)
                        yield data[4 * max(0, start - k * FRAME_IDS):4 * (end - k * FRAME_IDS)]

                yield doc_id, start, count, pieces()
            start += count


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator) -> Iterator:
        import struct

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        encode, end = encoder(tokenizer, blank_with_word=True), struct.pack("<I", end_id)
        part = TaskContext.get().partitionId()
        files, place = fs.FileSystem.from_uri(folder)
        name = f"{place}/part-{part:08d}.tokens"
        writer = sink = None
        fresh = f"{place}/.{uuid.uuid4()}"
        for batch in batches:
            if batch.num_rows and writer is None:
                sink = files.open_output_stream(fresh)
                writer = TokenFileWriter(sink)
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc_id, ids in zip(doc_ids[a:b].to_pylist(), encode(texts[a:b])):
                    writer.add(doc_id, ids + end)
            kind = doc_ids.type
        if writer is not None:
            n_ids = writer.close(kind)
            sink.close()
            files.move(fresh, name)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [f"{folder}/part-{part:08d}.tokens"],
                "n_docs": pa.array([len(writer.counts)], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return run


def write_token_files(df: DataFrame, folder: str, tokenizer: str, *, text: str = "text", id_column: str = "doc_id",
                      end_id: int = 0) -> DataFrame:
    """Encodes all texts into token files below ``folder``, a URI that all executors reach.

    Returns the manifest (part, file, n_docs, n_ids), stored; parts are in ascending order of the ids,
    and so are the documents in each. NULL ids come first; rows of equal ids are in the order of a hash
    of the text, then of the text. A NULL text counts as empty. An empty table gives no file.
    """
    rows = df.select(col(id_column).alias("id"), F.coalesce(col(text), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return stored(ranged.mapInArrow(_write(folder, tokenizer, end_id), "part int, file string, n_docs long, n_ids long"))


def _read(wanted):
    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                files, place = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(place) as source:
                    reader = TokenFileReader(source, source.size())
                    kind, out = reader.index.schema.field("doc_id").type, []
                    for doc_id, start, count, pieces in reader.documents(wanted):
                        crc = 0
                        for piece in pieces:
                            crc = zlib.crc32(piece, crc)
                        out.append((doc_id, row["before"] + start, count, crc))
                ids, *numbers = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kind), *(pa.array(n, pa.int64()) for n in numbers)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_token_files(manifest: DataFrame, id_type: str = "bigint", wanted: Collection | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files, or of those with a wanted id.

    ``start`` counts the ids of all documents before, over all files; the CRC-32 covers the document's
    ids as little-endian unsigned 32-bit integers. Every frame that is read is checked.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    files = max(1, manifest.count())
    return placed.repartition(files).mapInArrow(
        _read(wanted), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes token files to a new folder of the shared storage and reads all documents back."""
    spark: SparkSession = df.sparkSession
    folder = shared_folder(spark)
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    kind = df.schema[options.get("id_column", "doc_id")].dataType.simpleString()
    return read_token_files(write_token_files(df, folder, tokenizer, **options), kind)
