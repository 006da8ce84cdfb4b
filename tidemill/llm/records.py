"""Token ids in length-delimited binary records, with an index of offsets beside each file.

A record is framed as readers of such files know it: the payload's length in 8 bytes, the length's masked CRC-32C, the
payload, the payload's masked CRC-32C (all little-endian; a checksum is masked by turning it right by 15 bits and adding a
constant). A payload is a document's id and its token ids: one byte of flags (1: there is an id, 2: token ids take four
bytes, else two), the id in 8 bytes, the token ids. The index has offset, length of payload and number of tokens of each
record (8 bytes each), then the masked CRC-32C of all that; so records can be read in any order, and where a document's
tokens begin is known without reading one.

Documents are dealt to tasks by ranges of their ids, so files in order hold them in ascending order, whatever the number of
tasks; each task writes files of about FILE_BYTES, under names of its own, and only those of tasks that ended well are
listed. The driver sees one row for each file. Reading joins what lies side by side in a file to one range.

Defined cases: a null text has the end id alone, as an empty one; null ids come first, as one row each; rows that share an
id are ordered by a hash of their texts, repeated ones are records of their own. An empty table gives no files. Extra
columns are ignored. A damaged length, payload or index raises RecordError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import clash_free, scratch, stored, table
from tidemill.llm.files import file_system
from tidemill.llm.packing import word_tokens, word_vocabulary

END_ID, FILE_BYTES, RANGE_BYTES, BATCH_TOKENS = 2, 1 << 28, 1 << 22, 1 << 20
#: Fixed values of the framing: the checksum's polynomial (reflected) and what masking adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
HAS_ID, WIDE = 1, 2


class RecordError(ValueError):
    """A file or its index is not what was written."""


# --- checksums -----------------------------------------------------------------------------------------------------


def _through_byte(c: np.ndarray, table_: np.ndarray) -> np.ndarray:
    return table_[c & 0xFF] ^ (c >> 8)


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ (np.uint32(POLYNOMIAL) * (c & 1))
    return c


class Crc32c:
    """CRC-32C of many messages at once.

    A checksum is linear in the message's bits: those of both halves make that of the whole, once the left one is carried
    over the right one's length. So messages are laid out in rows of a power of two words (zeros in front change nothing),
    every word gets its checksum from a table, and neighbours are joined until one is left. Tables come from a rule.
    """

    def __init__(self):
        self.bytes = _byte_table()
        half = np.arange(1 << 16, dtype=np.uint32)
        self.two = _through_byte(_through_byte(half, self.bytes), self.bytes)
        self.over = [(_through_byte(half, self.bytes), _through_byte(half << 16, self.bytes))]  # over 1, 2, 4, ... zero bytes

    def carried(self, c: np.ndarray, power: int) -> np.ndarray:
        """Checksums after 2 ** power zero bytes more."""
        while len(self.over) <= power:
            low, high = self.over[-1]
            twice = lambda x: low[x & 0xFFFF] ^ high[x >> 16]
            self.over.append((twice(low), twice(high)))
        low, high = self.over[power]
        return low[c & 0xFFFF] ^ high[c >> 16]

    def __call__(self, messages: list[bytes]) -> np.ndarray:
        lengths = np.array([len(m) for m in messages], np.int64)
        words = np.maximum((lengths + 3) // 4, 1)
        power = np.ceil(np.log2(words)).astype(int)
        out = np.zeros(len(messages), np.uint32)
        for p in np.unique(power):
            own = np.flatnonzero(power == p)
            step = max(1, (1 << 20) >> p)
            for i in range(0, len(own), step):
                out[own[i : i + step]] = self._rows([messages[j] for j in own[i : i + step]], 4 << p)
        state = np.full(len(messages), 0xFFFFFFFF, np.uint32)
        for bit in range(int(lengths.max(initial=0)).bit_length()):
            state = np.where(lengths >> bit & 1, self.carried(state, bit), state)
        return out ^ state ^ np.uint32(0xFFFFFFFF)

    def _rows(self, messages: list[bytes], width: int) -> np.ndarray:
        w = np.frombuffer(b"".join(m.rjust(width, b"\0") for m in messages), "<u4").reshape(len(messages), -1)
        c = self.two[w & 0xFFFF]
        c = self.two[(c ^ (w >> 16)) & 0xFFFF] ^ (c >> 16)
        power = 2
        while c.shape[1] > 1:
            c = self.carried(c[:, ::2], power) ^ c[:, 1::2]
            power += 1
        return c[:, 0]

    def masked(self, messages: list[bytes]) -> np.ndarray:
        c = self(messages)
        return ((c >> 15) | (c << 17)) + np.uint32(MASK)


# --- records -------------------------------------------------------------------------------------------------------


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) > 0 and int(ids.max()) >= 1 << 16
    head = struct.pack("<Bq", (HAS_ID if doc_id is not None else 0) | (WIDE if wide else 0), doc_id or 0)
    return head + ids.astype("<u4" if wide else "<u2").tobytes()


def parsed(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", data)
    return doc_id if flags & HAS_ID else None, np.frombuffer(data, "<u4" if flags & WIDE else "<u2", offset=9)


def framed(payloads: list[bytes], crc: Crc32c) -> bytes:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    pack = struct.Struct("<I").pack
    return b"".join(x for n, a, p, b in zip(lengths, crc.masked(lengths), payloads, crc.masked(payloads)) for x in (n, pack(a), p, pack(b)))


def unframed(data: bytes, lengths: list[int], crc: Crc32c) -> list[bytes]:
    """The payloads of records that lie side by side. Both checksums of each must hold, and the lengths be those of the index."""
    heads, payloads, sums, at = [], [], [], 0
    for n in lengths:
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        sums.append((data[at + 8 : at + 12], data[at + 12 + n : at + 16 + n]))
        at += n + 16
    if at != len(data) or any(int.from_bytes(h, "little") != n for h, n in zip(heads, lengths)):
        raise RecordError("a record's length is not the index's")
    for found, (head, body) in zip(zip(crc.masked(heads), crc.masked(payloads)), sums):
        if (int(found[0]), int(found[1])) != (int.from_bytes(head, "little"), int.from_bytes(body, "little")):
            raise RecordError("a record's checksum does not hold")
    return payloads


class Writer:
    """A file of records and its index, as they come."""

    def __init__(self, folder: str, crc: Crc32c):
        system, base = file_system(folder)
        system.create_dir(base)
        name = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        self.file, self.crc, self.system, self.path = f"{folder}/{name}.rec", crc, system, f"{base}/{name}"
        self.out = system.open_output_stream(f"{self.path}.rec")
        self.at, self.tokens, self.entries = 0, 0, []

    def add(self, rows: list[tuple[int | None, np.ndarray]]) -> None:
        payloads = [payload(*r) for r in rows]
        self.out.write(framed(payloads, self.crc))
        for p, (_, ids) in zip(payloads, rows):
            self.entries.append((self.at, len(p), len(ids)))
            self.at += len(p) + 16
            self.tokens += len(ids)

    def close(self) -> tuple[str, int, int, int]:
        self.out.close()
        index = np.array(self.entries, "<u8").tobytes()
        with self.system.open_output_stream(f"{self.path}.idx") as f:
            f.write(index + struct.pack("<I", self.crc.masked([index])[0]))
        return self.file, len(self.entries), self.tokens, self.at


def written(docs: DataFrame, folder: str, vocabulary: str | Callable[[], str], end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes documents (doc_id, text) to a folder; lists the files: file, records, tokens, bytes, first (tokens before it)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, crc, number, own = word_tokens(vocabulary() if callable(vocabulary) else vocabulary), Crc32c(), 0, None
        end = np.array([end_id], "<u4").tobytes()

        def listed() -> pa.RecordBatch:
            row = (TaskContext.get().partitionId(), number, *own.close())
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["part", "number", "file", "records", "tokens", "bytes"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                own = own or Writer(folder, crc)
                data = tokens(part.column(1).to_pylist())
                own.add([(d, np.frombuffer(b + end, "<u4")) for d, b in zip(part.column(0).to_pylist(), data)])
                if own.at >= file_bytes:
                    yield listed()
                    number, own = number + 1, None
        if own:
            yield listed()

    rows = clash_free(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = stored(rows.mapInArrow(write, "part long, number long, file string, records long, tokens long, bytes long"), "record-files").orderBy("part", "number").collect()
    first, listing = 0, []
    for r in files:
        listing.append((r.file, r.records, r.tokens, r.bytes, first))
        first += r.tokens
    return docs.sparkSession.createDataFrame(listing, "file string, records long, tokens long, bytes long, first long")


# --- reading -------------------------------------------------------------------------------------------------------


def entries(files: DataFrame) -> DataFrame:
    """file, offset, length, n_tokens and start of each record, from the indexes, file by file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc32c()
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = file_system(file)
                with system.open_input_file(path.removesuffix(".rec") + ".idx") as f:
                    data = f.read()
                if len(data) % 24 != 4 or struct.pack("<I", crc.masked([data[:-4]])[0]) != data[-4:]:
                    raise RecordError("an index is damaged")
                index = np.frombuffer(data[:-4], "<u8").reshape(-1, 3).astype(np.int64)
                start = first + np.cumsum(index[:, 2]) - index[:, 2]
                for i in range(0, len(index), 1 << 16):
                    own = slice(i, i + (1 << 16))
                    columns = [pa.array([file] * len(index[own]))] + [pa.array(c) for c in (index[own, 0], index[own, 1], index[own, 2], start[own])]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "length", "n_tokens", "start"])

    # files are of about the same size: they are dealt, not their rows' few bytes
    dealt = files.select("file", "first").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return dealt.mapInArrow(read, "file string, offset long, length long, n_tokens long, start long")


def shuffled(listed: DataFrame, seed: int) -> DataFrame:
    """The records' entries in a pseudorandom order that depends on the seed alone, for an epoch of training."""
    key = F.xxhash64(F.lit(seed), "start", "n_tokens")
    return listed.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key").drop("key")


def read_records(listed: DataFrame, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and the ids if wanted, read
    from the files in the order of the entries. Both checksums of each record are verified."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        run: list[tuple] = []
        size = 0
        for batch in batches:
            for e in zip(*(c.to_pylist() for c in batch.columns)):
                if run and (e[0] != run[-1][0] or e[1] != run[-1][1] + run[-1][2] + 16 or size + e[2] > RANGE_BYTES):
                    yield run
                    run, size = [], 0
                run.append(e)
                size += e[2] + 16
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, rows, held = Crc32c(), [], 0
        opened = source = None

        def out() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + ([pa.array([r[4] for r in rows], pa.binary())] if ids else [])
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

        try:
            for run in ranges(batches):
                if opened != run[0][0]:
                    if source:
                        source.close()
                    opened = run[0][0]
                    system, path = file_system(opened)
                    source = system.open_input_file(path)
                source.seek(run[0][1])
                data = source.read(run[-1][1] + run[-1][2] + 16 - run[0][1])
                for (_, _, _, n, start), p in zip(run, unframed(data, [e[2] for e in run], crc)):
                    doc_id, tokens = parsed(p)
                    if len(tokens) != n:
                        raise RecordError("a record's tokens are not as many as the index says")
                    raw = tokens.astype("<u4").tobytes()
                    rows.append((doc_id, start, n, zlib.crc32(raw), raw if ids else b""))
                    held += n
                if held >= BATCH_TOKENS or len(rows) >= 1 << 14:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()
        finally:
            if source:
                source.close()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    return listed.select("file", "offset", "length", "n_tokens", "start").mapInArrow(read, schema)


def op12_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents written as records in the shared folder, and read back through the indexes."""
    folder = scratch(spark, "records")
    return read_records(entries(written(table(spark, sf_dir, "documents"), folder, word_vocabulary)), ids=False)
