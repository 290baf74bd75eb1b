"""Exact token counts at every prefix of a text, by prefix dynamic programming over byte-level BPE.

A sequence of BPE tokens is what its text encodes to exactly if every two neighbours are, and what is
left of an encoding without its last token encodes to itself. So of all tokens that end at a place just one
follows the last token of the prefix before it, and

    last(p) = the token t that ends at p and stays beside last(p - len(t)),   count(p) = count(p - len(t)) + 1.

An automaton over the vocabulary names the tokens that end at each place, the library tells once per pair
whether two tokens stay side by side. That is done within a unit of the tokenizer's pattern; the units of a
prefix are those of the whole text but for its end: white space before a word belongs to one unit until the
word begins, and a contraction is a mark and letters until it is complete. Those few places are cut anew
by the library. Texts are cut at single spaces between other characters, where no unit reaches across, so
the steps of equal chunks are worked out once.

with_counts() stores per text an array of one number per character and a zero before them:
``counts[p]`` is the number of tokens of the first p characters. Questions are then SQL over that column, with
no tokenizer: count_of_prefix, longest_prefix, truncated, and pieces (cuts between chunks, for budgets of a window).

Edge cases: null text counts as empty (counts = [0]); special strings inside a text are one token, as in the
library, and ordinary text while they are incomplete; very long texts and texts without any space take time
and memory linear in their length (a pair of positions per token that ends there); repeated rows give equal
arrays; an empty table gives an empty result; a column that has the name of the new one is replaced.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._chunks import CUT, STOPS, ChunkEncoder, latin
from rosterlake.llm._common import held, load, parts, ship
from rosterlake.llm.token_records import _AS_TEXT

#: Known chunks, pairs and units of a worker; bytes of text handled at once.
CHUNKS, PAIRS, UNITS, AT_ONCE = 150_000, 400_000, 100_000, 2_000_000
STEP = np.dtype("<i2")


class PrefixCounter:
    """Token counts of all prefixes for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain or model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a byte-level BPE without normaliser")
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens that take their surroundings are not supported")
        if not set(_AS_TEXT.values()) <= set(model["vocab"]):
            raise ValueError(f"{path}: not every byte has a token")
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.units = self.tokenizer.model, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.token: list[str] = [""] * (max(model["vocab"].values()) + 1)
        self.ends = ahocorasick.Automaton()
        for word, i in model["vocab"].items():
            if word not in self.special:
                self.token[i] = word
                self.ends.add_word(word, (len(word), i))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.steps = ChunkEncoder(self._chunk, most=CHUNKS)

    def _stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when their text is encoded."""
        got = self.pairs.get(a << 32 | b)
        if got is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            made = self.model.tokenize(self.token[a] + self.token[b])
            got = self.pairs[a << 32 | b] = len(made) == 2 and made[0].id == a and made[1].id == b
        return got

    def _alone(self, a: int) -> bool:
        got = self.whole.get(a)
        if got is None:
            made = self.model.tokenize(self.token[a])
            got = self.whole[a] = len(made) == 1 and made[0].id == a
        return got

    def unit(self, shown: str) -> list[int]:
        """Counts after 0, 1, 2 ... bytes of one unit, which is written in the vocabulary's letters. Not to be changed."""
        found = self.known.get(shown)
        if found is not None:
            return found
        last, count = [-1] * (len(shown) + 1), [0] * (len(shown) + 1)
        pairs, whole = self.pairs, self.whole
        for end, (size, token) in self.ends.iter(shown):
            at = end + 1
            if last[at] >= 0:
                continue
            since = at - size
            if since:
                fits = pairs.get(last[since] << 32 | token)
                if fits is None:
                    fits = self._stays(last[since], token)
            else:
                fits = whole.get(token)
                if fits is None:
                    fits = self._alone(token)
            if fits:
                last[at], count[at] = token, count[since] + 1
        if len(shown) <= 32:
            if len(self.known) > UNITS:
                self.known.clear()
            self.known[shown] = count
        return count

    def _total(self, text: str) -> int:
        return sum(self.unit(shown)[-1] for shown, _ in self.units(text))

    def _counts(self, chunk: str) -> list[int]:
        """Counts of the prefixes of 1, 2 ... characters of a text without special strings."""
        if latin(chunk[1:] if chunk[:1] == " " else chunk):
            shown = chunk.encode().decode("latin-1").translate(_AS_TEXT)
            count = self.unit(shown)[1:]
            return count if len(count) == len(chunk) else self._by_character(chunk, count)
        out: list[int] = []
        base, before, start_before = 0, 0, 0
        for shown, (start, end) in self.units(chunk):
            piece = chunk[start:end]
            count = self.unit(shown)
            own = self._by_character(piece, count[1:]) if len(shown) != len(piece) else count[1:]
            out += [base + c for c in own]
            # a prefix that ends inside the first characters may have other units than the whole text
            odd = 0
            if start and piece[0].isspace() and chunk[start - 1].isspace():
                odd = 1
            elif piece[0] == "'" and 2 < len(piece) <= 3:
                odd = 2
            for p in range(start + 1, start + odd + 1):
                out[p - 1] = before + self._total(chunk[start_before:p])
            before, start_before, base = base, start, base + count[-1]
        return out

    @staticmethod
    def _by_character(piece: str, count: list[int]) -> list[int]:
        """The counts at the ends of characters, of those at all bytes."""
        out, at = [], -1
        for c in piece:
            o = ord(c)
            at += 1 if o < 128 else 2 if o < 2048 else 3 if o < 65536 else 4
            out.append(count[at])
        return out

    def _chunk(self, chunk: str) -> bytes:
        """Steps from count to count, character by character."""
        if not chunk:
            return b""
        word, stop = (chunk[1:-1], chunk[-1]) if chunk[-1] in STOPS else (chunk[1:], "")
        if chunk[0] == " " and word.isascii() and word.isalpha():  # one unit, and a stop is another
            count = self.unit(_AS_TEXT[32] + word)
            return array("h", [*map(sub, count[1:], count), *self.unit(stop)[1:]]).tobytes()
        counts = self._counts(chunk)
        return array("h", map(sub, counts, chain((0,), counts))).tobytes()

    def counts(self, text: str | None) -> np.ndarray:
        """Counts after 0, 1, 2 ... characters of a text."""
        text = text or ""
        first = [(text.find(s), s) for s in self.special if s in text]
        if not first:
            steps = np.frombuffer(self.steps(text), STEP)
            out = np.zeros(len(steps) + 1, np.int32)
            np.cumsum(steps, out=out[1:])
            return out
        return self._around(text)

    def _around(self, text: str) -> np.ndarray:
        """counts() of a text with special strings: each is one token and parts the text before from that behind."""
        out, done, total = [np.zeros(1, np.int32)], 0, 0
        while done < len(text):
            found = [(at, -len(s), s) for s in self.special if (at := text.find(s, done)) >= 0]
            if not found:
                rest = self._plain(text[done:])
                out.append(rest[1:] + total)
                break
            at, _, s = min(found)
            # until it is complete it is ordinary text behind the text before
            open_ = self._plain(text[done : at + len(s) - 1]) + total
            total += int(open_[at - done] - total) + 1
            out += [open_[1:], np.array([total], np.int32)]
            done = at + len(s)
        return np.concatenate(out).astype(np.int32)

    def _plain(self, text: str) -> np.ndarray:
        steps = np.frombuffer(self.steps(text), STEP)
        return np.cumsum(np.append(np.zeros(1, np.int64), steps))


def _counter(path: str) -> PrefixCounter:
    """One per worker process, so that later tasks find known chunks."""
    return held(("prefix counts", path), lambda: PrefixCounter(path))


def with_counts(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "counts") -> DataFrame:
    """docs plus the array of token counts of all prefixes of a text column (one pass, no shuffle)."""
    ship(docs.sparkSession)
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(tokenizer).counts
        for b in chain.from_iterable(parts(w, w.num_columns - 1, AT_ONCE) for w in batches):
            got = [count(t) for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(ends, np.concatenate(got))], [*kept, into])

    frame = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-1], T.StructField(into, T.ArrayType(T.IntegerType()))]))


def n_tokens(counts: str = "counts") -> Column:
    """Tokens of the whole text."""
    return F.get(counts, F.size(counts) - 1).cast("long")


def count_of_prefix(characters: Column | int, counts: str = "counts") -> Column:
    """Tokens of the first characters of the text; of the whole text where it is shorter."""
    return F.get(counts, F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(counts) - 1)).cast("long")


def longest_prefix(budget: int, counts: str = "counts") -> Column:
    """Characters of the longest prefix that has at most budget tokens. Counts can fall from one place to the
    next (a merge takes in what was two), so the last such place is asked for, not the first one above."""
    if budget < 0:
        raise ValueError("a budget is no negative number")
    fits = F.transform(F.reverse(counts), lambda c: c <= budget)
    return F.when(n_tokens(counts) <= budget, F.size(counts) - 1).otherwise(F.size(counts) - F.array_position(fits, True)).cast("long")


def truncated(budget: int, text: str = "text", counts: str = "counts") -> Column:
    """The longest prefix of the text with at most budget tokens."""
    return F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), longest_prefix(budget, counts).cast("int"))


def pieces(docs: DataFrame, budget: int, text: str = "text", counts: str = "counts", into: str = "piece") -> DataFrame:
    """A row per piece of a text (numbered from 0): as many whole chunks as have at most budget tokens together.
    The columns of the text and of its counts are left out, as every piece would carry them whole.

    A piece's count is the difference of the stored counts at its ends, and equals what the library
    gives for the piece alone, as no unit reaches across a cut. A chunk over the budget is a piece by itself.
    Null and empty texts, and rows without counts, have no piece.
    """
    from pyspark.sql import types as T

    kept = [c for c in docs.columns if c not in (into, "piece_tokens", "piece_number", text, counts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(parts(w, w.num_columns - 2, AT_ONCE) for w in batches):
            rows, number, said, size = [], [], [], []
            for i, (t, c) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1), strict=True)):
                if t is None or not c.is_valid:
                    continue
                for n, (lo, hi, tokens) in enumerate(_pieces(t, c.values.to_numpy(), budget)):
                    rows.append(i)
                    number.append(n)
                    said.append(t[lo:hi])
                    size.append(tokens)
            own = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(number, pa.int32()), pa.array(said, pa.string()), pa.array(size, pa.int64())], [*kept, "piece_number", into, "piece_tokens"])

    frame = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"), docs[counts].alias("__counts"))
    new = [T.StructField("piece_number", T.IntegerType()), T.StructField(into, T.StringType()), T.StructField("piece_tokens", T.LongType())]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-2], *new]))


def _pieces(text: str, counts: np.ndarray, budget: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of one text."""
    cuts = [m.start() for m in CUT.finditer(text)] + [len(text)]
    start = last = 0
    for at in cuts:
        if counts[at] - counts[start] > budget and last > start:
            yield start, last, int(counts[last] - counts[start])
            start = last
        last = at
    if last > start:
        yield start, last, int(counts[last] - counts[start])


LIMIT = 512


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = load(spark, sf_dir, "documents", spread=True).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    done = with_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", n_tokens().alias("n_tokens"), (n_tokens() > LIMIT).alias("over_limit"), longest_prefix(LIMIT).alias("chars_in_limit"))
