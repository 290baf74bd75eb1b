"""Token ids as length-delimited binary records with masked checksums and an offset index.

A file holds one record per document: an unsigned 64-bit length, the masked CRC of those eight
bytes, the payload and the masked CRC of the payload. A payload is one byte for the width of an id
(2 or 4), a signed 64-bit document id behind one byte that says whether it is null, and the ids,
all little-endian. The checksum is CRC-32 rotated right by 15 bits plus a constant, so that a
checksum stored inside a payload does not check itself. Beside each file lies an index: per record
its byte offset, its number of ids and the ids before it in the file, for reads in any order.

Files follow ascending doc_id. The manifest (one row per file) is what the driver holds.

The tokenizer reads whole texts cut at single spaces between non-space characters. Its pattern
never matches across such a place, so equal chunks have equal ids and are encoded once.

Edge cases: null text counts as empty and gives just the end id; null ids sort first; repeated ids
order by the text's hash; an empty table gives no file and no row.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._chunks import STOPS, ChunkEncoder, latin
from rosterlake.llm._common import fresh_dir, load, ship

#: Fixed value: added to the rotated checksum.
MASK = 0xA282EAD8
MANIFEST = "file string, part int, bytes long, records long, ids long"
PER_FILE = 8_000_000  # characters a file holds, about


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<BBq", wide, doc_id is None, doc_id or 0) + ids.astype(f"<u{wide}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    wide, null, doc_id = struct.unpack_from("<BBq", payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{wide}", offset=10)


def read_record(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at an offset and the offset behind it; ValueError if a length or checksum is wrong."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"bad length at byte {at}")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"bad payload at byte {at}")
    return payload, at + 16 + n


#: Fixed value: how byte-level BPE writes the bytes that are not printable as they are.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
_AS_TEXT = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def byte_bpe(path: str):
    """Chunk to little-endian unsigned 32-bit ids, by the tokenizers library.

    A chunk of letters is one unit of the tokenizer's pattern and goes straight to its model; one
    final stop is a unit of its own; everything else takes the library's whole way.
    """
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    model, alone = t.model, {}

    def ids(chunk: str) -> list[int]:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if latin(word):
            # ASCII letters are written as they are
            shown = chunk.replace(" ", _AS_TEXT[32]) if word.isascii() else chunk.encode().decode("latin-1").translate(_AS_TEXT)
            return [x.id for x in model.tokenize(shown)]
        if word[-1:] in STOPS and latin(word[:-1]):
            return ids(chunk[:-1]) + ids(word[-1])
        head, line, tail = chunk.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return ids(head) + ids("\n") + ids(tail)
        if len(chunk) > 1:
            return t.encode(chunk, add_special_tokens=False).ids
        if chunk not in alone:
            alone[chunk] = t.encode(chunk, add_special_tokens=False).ids
        return alone[chunk]

    return lambda chunk: array("I", ids(chunk)).tobytes()


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    """One per worker process, so that later tasks find known chunks."""
    return ChunkEncoder(byte_bpe(path))


def write(docs: DataFrame, tokenizer: str, into: str, end_id: int = 0, key: str = "doc_id", text: str = "text", per_file: int = PER_FILE) -> DataFrame:
    """Encode docs into files under the folder into (which all executors share); returns the manifest.

    An attempt writes under names of its own and lists them in its rows, so a retried or doubled
    task leaves at worst a file that no manifest names.
    """
    spark = docs.sparkSession
    ship(spark)
    size = docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0]
    ordered = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).repartitionByRange(max(1, -(-size // per_file)), F.col("k"), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{into}/part-{part:06d}-{uuid.uuid4().hex}"
        encode, fs, base, out = _encoder(tokenizer), None, "", None
        offsets, counts, at, total = [], [], 0, 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for k, text in zip(keys, texts, strict=True):
                if out is None:
                    fs, base = pafs.FileSystem.from_uri(name)
                    fs.create_dir(os.path.dirname(base), recursive=True)
                    out = fs.open_output_stream(base)
                ids = np.append(np.frombuffer(encode(text), "<u4"), np.uint32(end_id))
                record = frame(pack(k, ids))
                out.write(record)
                offsets.append(at)
                counts.append(len(ids))
                at += len(record)
        if out is not None:
            out.close()
            total = int(sum(counts))
            before = np.cumsum([0, *counts[:-1]])
            with fs.open_output_stream(f"{base}.idx") as index:
                index.write(np.array([offsets, counts, before], "<u8").T.tobytes())
            yield pa.record_batch([pa.array([name]), pa.array([part], pa.int32()), pa.array([at]), pa.array([len(counts)]), pa.array([total])], ["file", "part", "bytes", "records", "ids"])

    return ordered.mapInArrow(run, MANIFEST)


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, ids of every record of the files, a task per file; checks lengths and checksums."""
    files, start = [], 0
    for row in sorted(manifest, key=lambda r: r["part"]):
        files.append((row["file"], start))
        start += row["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, base = pafs.FileSystem.from_uri(name)
                with fs.open_input_stream(f"{base}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)
                with fs.open_input_file(base) as f:
                    for lo in range(0, len(index), 256):
                        hi = min(lo + 256, len(index))
                        f.seek(int(index[lo, 0]))
                        data = f.read(int(index[hi, 0] - index[lo, 0]) if hi < len(index) else None)
                        got = [unpack(read_record(data, int(o - index[lo, 0]))[0]) for o in index[lo:hi, 0]]
                        if any(len(ids) != n for (_, ids), n in zip(got, index[lo:hi, 1], strict=True)):
                            raise ValueError(f"{name}: index and records differ")
                        yield pa.record_batch([pa.array([d for d, _ in got], pa.int64()), pa.array([first + int(s) for s in index[lo:hi, 2]], pa.int64()), pa.array([ids.astype("<u4").tobytes() for _, ids in got], pa.binary())], ["doc_id", "start", "ids"])

    rows = spark.createDataFrame(files, "file string, start long")
    return rows.repartition(max(1, len(files))).mapInArrow(run, "doc_id long, start long, ids binary")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents")
    manifest = write(docs, public_tokenizers.path("byte_bpe_50k.json"), fresh_dir(spark, "records")).collect()
    if not manifest:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, manifest).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
