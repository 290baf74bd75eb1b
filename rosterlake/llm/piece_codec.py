"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read directly (wire format): pieces with scores and types, the kind of model,
byte fallback, and the normaliser's rules. From these a tokenizers pipeline is rebuilt: the compiled
character map as normaliser, the metaspace marker for spaces, unigram scores as they are, or for a
BPE model the merges that the scores imply, and byte fallback.

Where no piece has the marker behind another character, texts are cut at single spaces between
non-space characters, and each distinct chunk is encoded once: the chunks of a batch that were not met
before go through the library's batch call together, on one thread (Spark's tasks fill the cores). Their ids are compared with the
sentencepiece library's (parity of a document: that of all its chunks). The round trip is of whole
documents: the ids of every text are decoded in batches and compared with the text (for models that
normalise: with the normalised text). Models that cannot be cut encode whole texts in batches.

Edge cases: null and empty text have no ids and pass both checks; a character outside the pieces
becomes byte pieces, or the unknown id where the model has no byte fallback (then the round trip is
false); repeated rows give equal ids; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._chunks import chunks
from rosterlake.llm._common import held, load, parts, ship

MARK = "▁"
#: Known chunks of a worker (two generations of so many), characters of a batch, threads of a batch call.
CACHE, AT_ONCE, THREADS = 100_000, 600_000, 1
#: Field numbers and enumerations of the model protobuf.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message; varints as int, the rest as bytes."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == PIECES:
            f = dict(_fields(value))
            score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
            spec.pieces.append((f[1].decode(), score, f.get(3, NORMAL)))
        elif number == TRAINER:
            f = dict(_fields(value))
            spec.kind, spec.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif number == NORMALIZER:
            f = dict(_fields(value))
            spec.charsmap, spec.dummy_prefix, spec.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every split of every piece into two pieces, best score first."""
    rank = {p: i for i, (p, _, t) in enumerate(spec.pieces) if t in (NORMAL, USER)}
    found = []
    for p, score, t in spec.pieces:
        if t == NORMAL:
            found += [(-score, rank[p[:i]], rank[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


def build(spec: Spec):
    """The tokenizers pipeline, without the dummy prefix (the caller adds it to whole texts)."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unknown, spec.byte_fallback)
    elif spec.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges(spec), unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=0)  # Codec keeps known chunks itself
    else:
        raise ValueError(f"model kind {spec.kind} is not rebuilt")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " ")]
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    # the marker becomes a space by a plain exchange of characters; Replace runs a pattern on every token
    t.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never"), decoders.ByteFallback(), decoders.Fuse()])
    t.add_tokens([AddedToken(p, normalized=False) for p, _, k in spec.pieces if k == USER])
    return t


class Codec:
    """Encode and decode whole texts in batches; new chunks are compared with the other library."""

    def __init__(self, path: str, verify: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.spec = parse_model(data)
        self.tokenizer = build(self.spec)
        self.plain = not self.spec.charsmap and not self.spec.squeeze
        self.cuttable = self.plain and not any(MARK in p.lstrip(MARK) for p, _, _ in self.spec.pieces)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unlike: set[str] = set()
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)

    def whole(self, text: str) -> str:
        """The text as the pipeline takes it, with the space that the model puts before texts."""
        text = text.strip(" ") if self.spec.squeeze else text
        return " " + text if text and self.spec.dummy_prefix else text

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks that were not met before, and whether the other library has the same."""
        for lo in range(0, len(new), 2048):
            some = new[lo : lo + 2048]
            got = [e.ids for e in self.tokenizer.encode_batch_fast([self._full(c) for c in some], add_special_tokens=False)]  # no offsets
            self.known.update(zip(some, (array("I", ids).tobytes() for ids in got), strict=True))
            if self.reference is not None:
                other = self.reference.encode([self._bare(c) for c in some], num_threads=1)
                if got != other:
                    self.unlike.update(c for c, mine, its in zip(some, got, other, strict=True) if mine != its)

    def _full(self, chunk: str) -> str:
        """A chunk that is a word stands for the word behind its space."""
        return " " + chunk if self.spec.dummy_prefix and chunk[:1] != " " else chunk

    def _cut(self, texts: list[str], took: list[str]) -> tuple[list[list[str]], set[str]]:
        """Chunks of texts (their words, where each space is a place to cut), and the different ones that are not known."""
        if self.cuttable and self.spec.dummy_prefix:
            cut = [t.split(" ") if t else [] for t in texts]
            new = set().union(*cut).difference(self.known)
            # each different word is looked at once; known ones are none of these
            odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
            if not odd:
                return cut, new
            cut = [c if odd.isdisjoint(c) else chunks(w) for c, w in zip(cut, took, strict=True)]
        else:
            cut = [(chunks(w) if self.cuttable else [w]) if w else [] for w in took]
        return cut, set().union(*cut).difference(self.known)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        took = [self.whole(t or "") for t in texts]
        if len(self.known) > CACHE:
            self.old, self.known = self.known, {}
        cut, wanted = self._cut([t or "" for t in texts], took)
        again = wanted.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        self._learn(list(wanted - again))
        ids = [np.frombuffer(b"".join(map(self.known.__getitem__, c)), "<u4") for c in cut]
        if not self.cuttable:
            self.known.clear()  # whole texts seldom come again
        back = self.decode([i.tolist() for i in ids])
        # what decoding must give: the text, or for models that normalise, the normalised one
        same = [self._plain(t) for t in took]
        return [(i, self.unlike.isdisjoint(c), b == t) for i, c, b, t in zip(ids, cut, back, same, strict=True)]

    def _plain(self, took: str) -> str:
        text = took if self.plain else self.tokenizer.normalizer.normalize_str(took).replace(MARK, " ")
        return self._bare(text)

    def _bare(self, text: str) -> str:
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self._bare(t) for t in self.tokenizer.decode_batch(ids, skip_special_tokens=False)]


def _codec(path: str, verify: bool) -> Codec:
    """One per worker process, so that later tasks find known chunks."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # each thread keeps memory of its own
    return held(("pieces", path, verify), lambda: Codec(path, verify))


def encode(docs: DataFrame, model: str, text: str = "text", verify: bool = True) -> DataFrame:
    """docs plus ids array<int>, parity and round_trip; columns of docs with these names are replaced."""
    ship(docs.sparkSession)
    from pyspark.sql import types as T

    new = ("ids", "parity", "round_trip")
    kept = [c for c in docs.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, verify)
        for whole in batches:
            for b in parts(whole, whole.num_columns - 1, AT_ONCE):
                got = codec.encode(b.column(b.num_columns - 1).to_pylist())
                flat = np.concatenate([i for i, _, _ in got]).astype(np.int32)
                ids = pa.ListArray.from_arrays(np.cumsum([0, *(len(i) for i, _, _ in got)]).astype(np.int32), flat)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array([p for _, p, _ in got]), pa.array([r for _, _, r in got])], [*kept, *new])

    frame = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("parity", T.BooleanType()), T.StructField("round_trip", T.BooleanType())])
    return frame.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows plus the decoded text of their ids; null ids give null."""
    ship(rows.sparkSession)
    from pyspark.sql import types as T

    kept = [c for c in rows.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, False)
        for b in batches:
            told = b.column(b.num_columns - 1).to_pylist()
            back = iter(codec.decode([i for i in told if i is not None]))
            got = [None if i is None else next(back) for i in told]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())], [*kept, into])

    frame = rows.select(*kept, rows[ids].alias("__ids"))
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(into, T.StringType())]))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode(load(spark, sf_dir, "documents", spread=True).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "parity", "round_trip")
