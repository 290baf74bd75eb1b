"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

Equal word sequences are one node, named by their 128-bit hash. A node's shingle set is hashed to
64 bits; HASHES multiplications give as many minima. BANDS bands of ROWS minima make candidates (a
pair of similarity 0.8 shares no band with probability 4e-8). Of every minimum the low B bits are
kept and packed into 64-bit words; the count of equal B-bit fields, corrected for chance hits,
estimates a pair's similarity, and pairs estimated below MARGIN under the threshold are dropped.

Candidates do not grow with the square of a bucket. First, every node meets one centre of each of
its buckets (the member that shares most buckets with others), and its best-estimated centres are
confirmed; the links make components. Then only nodes outside the largest component of a bucket meet
that bucket's members of other components, under the estimate and a closer one (FINE one-bit minima,
made for these nodes alone). A pair inside one component needs
no confirmation: every candidate pair is confirmed, already joined or refused by an estimate. A pair of
similarity 0.8 is lost by the bands and both estimates together with probability 1.1e-7 at most.

Edge cases: null or empty text, or text of white space only, has an empty set, links with nothing
and is its own component; fewer words than a shingle make one shingle of the whole sequence;
repeated rows and repeated ids fall together by their text; a null id takes part, and a component
is named by its smallest id that is not null (null where all are); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, held, load, parts, ship, stored, words
from rosterlake.llm.components import components

HASHES, ROWS, B = 128, 4, 4
BANDS = HASHES // ROWS
#: A pair of similarity 0.8 is estimated below its margin with probability 2.5e-8 (51 or more
#: of 128 fields differ), and by the closer look's one-bit minima with 3.6e-8.
MARGIN = 0.22
FINE, FINE_MARGIN = 2048, 0.075
BEST = 2
CACHE = 250_000
_U = np.uint64
NODE = "doc_id long, rk binary, node binary, n_shingles long, bands array<long>, bits array<long>"


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_PLACE, _MIN, _FINE = _odd_numbers(64, 1), _odd_numbers(HASHES, 2), _odd_numbers(FINE, 3)


class _WordHashes(dict):
    """64-bit hashes of words, up to CACHE of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _word_hashes() -> _WordHashes:
    return held("word hashes", _WordHashes)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles (one for the whole sequence if shorter)."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hashes().__getitem__, w), np.uint64, len(w))
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, _U(len(w) if len(w) < k else k))
        for i in range(min(k, len(h))):
            s = (s ^ h[i : i + n]) * _PLACE[i]
            s ^= s >> _U(31)
    return np.unique(s)


def minima(s: np.ndarray, by: np.ndarray = _MIN) -> np.ndarray:
    """The minima of a non-empty set under the multipliers."""
    out = np.full(len(by), _U(0xFFFFFFFFFFFFFFFF))
    step = (1 << 18) // len(by)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), step):
            part = s[at : at + step]
            np.minimum(out, (part[None, :] * by[:, None]).min(1), out=out)
    return out ^ (out >> _U(33))


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, packed low bits) as signed 64-bit words."""
    m = minima(s)
    bands = m.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = (key ^ bands[:, r]) * _PLACE[r + 8]
            key ^= key >> _U(29)
    low = (m & _U((1 << B) - 1)).reshape(-1, 64 // B) << (np.arange(64 // B, dtype=np.uint64) * _U(B))
    return key.view(np.int64), np.bitwise_or.reduce(low, 1).view(np.int64)


def estimate(x, y):
    """Similarity of two packed signatures (columns): equal fields, less the share that chance gives."""
    ones = int("1" * (64 // B), 1 << B)
    differ = F.lit(0)
    for i in range(HASHES * B // 64):
        d = x[i].bitwiseXOR(y[i])
        for step in (1, 2):
            d = d.bitwiseOR(F.shiftrightunsigned(d, step))
        differ = differ + F.bit_count(d.bitwiseAND(F.lit(ones)))
    p = 2.0**-B
    return (1 - differ / F.lit(float(HASHES)) - p) / (1 - p)


def fine_bits(sets: DataFrame) -> DataFrame:
    """node, fine array<long>: one bit of each of FINE minima, for a closer estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits((minima(np.frombuffer(x, np.uint64), _FINE) & _U(1)).astype(np.uint8)).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(bits, pa.list_(pa.int64()))], ["node", "fine"])

    return sets.select("node", "set").mapInArrow(run, "node binary, fine array<long>")


def fine_estimate(x, y):
    """Similarity from one-bit minima: half of the unequal minima's bits agree by chance."""
    differ = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    return 1 - 2 * differ / F.lit(float(FINE))


def _row_key(key: str, text: str):
    """128 bits that name a row by its id and text."""
    said = F.coalesce(F.concat(F.lit("+"), F.col(text)), F.lit("-"))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), said).cast("binary")))


def named(doc_id, node):
    """A node's name: its smallest id (nulls last) before its hash, so that names sort by id."""
    order = F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.when(doc_id.isNull(), F.lit("01" + "0" * 16)).otherwise(F.concat(F.lit("00"), order)), F.hex(node)))


def id_of(name):
    """The id in a name; null where it has none."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number.cast("long"))


def node_of(name):
    return F.substring(name, 10, 16)


def nodes(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """One row per document: id, row key, node, set size, band keys and bits (null where the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(parts(b, 2) for b in batches):
            node, size, bands, bits = [], [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = shingle_set(t, k)
                one = signature(s) if len(s) else (None, None)
                node.append(xxhash.xxh3_128_digest(b" ".join(words(t))) if len(s) else None)
                size.append(len(s))
                bands.append(one[0])
                bits.append(one[1])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "rk", "node", "n_shingles", "bands", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), _row_key(key, text).alias("rk"), text).mapInArrow(run, NODE)


def _sets(docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(node, name, set) of the wanted (doc_id, node), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable(parts(b, 2) for b in batches):
            node, name, sets = [], [], []
            for want, told, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if xxhash.xxh3_128_digest(b" ".join(words(t))) == want:  # an id may stand at several texts
                    node.append(want)
                    name.append(told)
                    sets.append(shingle_set(t, k).tobytes())
            yield pa.record_batch([pa.array(node, pa.binary()), pa.array(name, pa.binary()), pa.array(sets, pa.binary())], ["node", "name", "set"])

    texts = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).filter("t IS NOT NULL")
    asked = wanted.select("doc_id", "node", named(F.col("doc_id"), F.col("node")).alias("name"))
    hit = texts.join(asked, F.col("d").eqNullSafe(F.col("doc_id"))).select("node", "name", "t")
    return hit.mapInArrow(run, "node binary, name binary, set binary").dropDuplicates(["node"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, by their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((p, q))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("name").alias("n"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("name").alias("m"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select(F.col("n").alias("a"), F.col("m").alias("b"), "x", "y").mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rk (row key), n_shingles, component_id, root of every row of docs.

    Links and components use names that start with a node's smallest id, so a component's root tells
    its smallest id and no table is ever dealt by root. root is null where a row has no shingle.
    """
    ship(docs.sparkSession)
    rows = stored(nodes(docs, k, key, text), "nodes")
    full = rows.filter("node IS NOT NULL")
    # one line per node: equal sequences fall together here
    one = stored(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "distinct")
    keyed = one.select("node", F.posexplode("bands").alias("band", "key")).select("node", "band", F.xxhash64("band", "key").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    member = stored(keyed.join(sizes, "key"), "members")
    weight = member.groupBy("node").agg(F.sum("n").alias("w"))
    sig = one.select("node", "doc_id", "bands", "bits").join(weight, "node")
    taking = stored(sig, "taking")
    centre = member.join(taking.select("node", "w"), "node").groupBy("key").agg(F.max(F.struct("w", "node")).alias("c")).select("key", F.col("c.node").alias("c"))
    floor = percent / 100 - MARGIN

    def bits(name: str) -> DataFrame:
        return taking.select(F.col("node").alias(name), F.col("bits").alias(f"{name}_bits"))

    met = member.join(centre, "key").filter("node <> c").select(F.col("node").alias("a"), F.col("c").alias("b")).distinct()
    judged = met.join(bits("a"), "a").join(bits("b"), "b").withColumn("e", estimate(F.col("a_bits"), F.col("b_bits"))).filter(F.col("e") >= floor)
    best = judged.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("e", "b")), asc=False), 1, BEST).alias("l")).select("a", F.explode("l").alias("x")).select("a", F.col("x.b").alias("b"))
    sets = stored(_sets(docs, taking, k, key, text), "sets")
    links = stored(confirm(best, sets, percent), "links")
    first = stored(components(links).select(node_of(F.col("node")).alias("node"), node_of(F.col("root")).alias("root")), "first")

    # what is left: buckets that hold several components
    labelled = member.select("node", "band", "key").join(first.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = labelled.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root")).alias("most")).filter("parts > 1").select("key", F.col("most.root").alias("most"))
    open_ = labelled.join(mixed, "key")
    fine = stored(fine_bits(sets.join(open_.select("node").distinct(), "node")), "fine")
    left = stored(open_.join(taking.select("node", "bands", "bits"), "node").join(fine, "node"), "left")
    p, q = left.alias("p"), left.alias("q")
    shared = F.expr("array_position(transform(zip_with(p.bands, q.bands, (x, y) -> x = y), z -> int(z)), 1) = p.band + 1")
    near = (estimate(F.col("p.bits"), F.col("q.bits")) >= floor) & (fine_estimate(F.col("p.fine"), F.col("q.fine")) >= percent / 100 - FINE_MARGIN)
    # each pair once: the smaller-named side leads unless only the other is outside the largest component
    lead = (F.col("p.root") != F.col("p.most")) & (F.col("p.root") != F.col("q.root")) & ((F.col("q.root") == F.col("q.most")) | (F.col("p.node") < F.col("q.node")))
    rest = p.join(q, (F.col("p.key") == F.col("q.key")) & lead & near & shared).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    more = confirm(rest, sets, percent)
    final = stored(components(links.union(more)), "final")
    label = final.select(node_of(F.col("node")).alias("node"), F.col("root"))
    label = label.union(one.join(label, "node", "left_anti").select("node", named(F.col("doc_id"), F.col("node"))))
    joined = full.select("doc_id", "rk", "node", "n_shingles").join(label, "node").select("doc_id", "rk", "n_shingles", id_of(F.col("root")).alias("component_id"), "root")
    done = stored(joined.union(rows.filter("node IS NULL").select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary"))), "groups")
    for df in (rows, one, member, taking, sets, links, first, fine, left, final):
        discard(df)
    return done


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each group: the row of the smallest id that is not null,
    then of the smallest row key; rows equal in id and text stay once. Rows without words all stay."""
    found = groups(docs, k, percent, key, text)
    best = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("m")).select(F.col("m.rk").alias("__rk"))
    kept = best.union(found.filter("root IS NULL").select("rk").distinct())
    return docs.withColumn("__rk", _row_key(key, text)).join(kept, "__rk").dropDuplicates(["__rk"]).drop("__rk")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(load(spark, sf_dir, "documents", spread=True), k=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS t FROM documents),
i AS (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM w WHERE len(t) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(t[i:i + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.c + y.c - k)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT both_.b, r.root FROM r JOIN both_ ON both_.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, coalesce(c.root, d.doc_id) AS component_id, coalesce(c.root, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
