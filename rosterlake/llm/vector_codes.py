"""Product codes of vectors, learned by Lloyd rounds whose members stay where their entry lives.

A vector of whole numbers is cut into equal parts. Each position has a codebook, whose entries start as that part
of the first vectors by id. The parts of all vectors are the members of the learning: they are partitioned by
(position, entry, salt), so the tasks that hold an entry's parts own it.

1. Every part is assigned to its nearest entry and sent to the owners once.
2. The owners add up their resident members; a line per task and entry goes to the driver's new codebook.
3. Every resident is assigned again. Those that keep their entry are written where they are, without
   a shuffle; only those that change it go through the next shuffle, to the owners of their new entry.

Steps 2 and 3 repeat; after the last codebook a scan of the vectors themselves assigns all parts, so the codes of a
vector are written in one row without gathering its parts. Every round's residents are Parquet in the
shared folder, and the round before is deleted. Entries may hold any share of all rows: the salt, a hash of the
row, deals an entry over SALTS owners, more where rows are many. All sums are whole numbers, so neither
the partitioning nor the order of members can change a result.

The codebooks (entries x components) are what tasks get and what the driver holds.

Edge cases: vectors that are null, or hold null or non-finite components, are left out; null ids sort last and are
kept; repeated ids are rows of their own (the first vectors are then ordered by their content, too); with fewer
vectors than entries the codebook has one entry each; ties go to the lower entry; entries without members stay;
lengths that no number of parts divides are filled with zeros; vectors of another length are coded by codebooks
of their own, learned from the vectors of that length; whole numbers beyond +-LARGEST are cut to it, so that no distance
exceeds a long; an empty table, or one without usable vectors, gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, fresh_dir, load, remove, ship, stored

#: Largest whole number of a component; owners of an entry, and rows of one owner at most on average.
LARGEST, SALTS, PER_OWNER = 1 << 27, 128, 500_000
MEMBER = "row long, d int, position int, entry int, part array<int>"
Books = dict[int, list[np.ndarray]]


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", scale: int = 4096) -> DataFrame:
    """vec_id, label, v (floor of scale times each component, as int) of the rows with usable vectors."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(float(scale)) * x.cast("double")))).cast("int"))
    return df.filter(F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def cut(v: np.ndarray, parts: int) -> list[np.ndarray]:
    """Equal parts of the rows of v; zeros fill the last ones up."""
    wide = -(-v.shape[1] // parts)
    v = np.pad(v, ((0, 0), (0, wide * parts - v.shape[1])))
    return [v[:, p * wide : (p + 1) * wide] for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower one of equals) and exact squared distance of each row."""
    x, book = x.astype(np.int64), book.astype(np.int64)
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:  # all sums are exact in doubles
        a, b = x.astype(float), book.astype(float)
        d = (((a * a).sum(1)[:, None] - 2 * (a @ b.T)) + (b * b).sum(1)).astype(np.int64)
    else:
        d = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    at = d.argmin(1)
    return at.astype(np.int32), d[np.arange(len(x)), at]


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the arrays of each length in a column of arrays of int."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy()
    starts = column.offsets.to_numpy()[:-1]
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


def first_entries(vectors: DataFrame, entries: int, parts: int) -> Books:
    """The codebooks to begin with: by length, the parts of its first vectors."""
    books: Books = {}
    for d in sorted(r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().collect()):
        some = vectors.filter(F.size("v") == d).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
        books[d] = cut(np.array([r["v"] for r in some], np.int64).reshape(len(some), d), parts)
    return books


def _assign(rows: DataFrame, books: Books, initial: bool) -> DataFrame:
    """Members with their nearest entries, and whether it is another one than before. At first the rows are
    (row, vector), of which every part becomes a member."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def told(row: pa.Array, d: int, position: int, entry: np.ndarray, moved: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        n, wide = part.shape
        lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * wide, wide, dtype=np.int32) if wide else np.zeros(n + 1, np.int32), pa.array(part.astype(np.int32).reshape(-1)))
        same = [pa.array(np.full(n, x, np.int32)) for x in (d, position)]
        return pa.record_batch([row, *same, pa.array(entry), lists, pa.array(moved)], ["row", "d", "position", "entry", "part", "moved"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in _rows(b.column(1)):
                d, row = v.shape[1], b.column(0).take(pa.array(at))
                for p, part in enumerate(cut(v, len(sent.value[d]))):
                    entry, _ = nearest(part, sent.value[d][p])
                    yield told(row, d, p, entry, np.ones(len(at), bool), part)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, position, before = (b.column(c).to_numpy() for c in (1, 2, 3))
            for at, v in _rows(b.column(4)):
                for key in sorted(set(zip(d[at].tolist(), position[at].tolist(), strict=True))):
                    own = np.flatnonzero((d[at] == key[0]) & (position[at] == key[1]))
                    entry, _ = nearest(v[own], sent.value[key[0]][key[1]])
                    yield told(b.column(0).take(pa.array(at[own])), *key, entry, entry != before[at[own]], v[own])

    return rows.mapInArrow(begin if initial else again, f"{MEMBER}, moved boolean")


def _means(members: DataFrame, books: Books) -> Books:
    """New codebooks: the floored mean of the members that live with each entry; entries without any stay."""
    shapes = {d: [b.shape for b in own] for d, own in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        for b in batches:
            d, position, entry = (b.column(c).to_numpy() for c in range(3))
            for at, v in _rows(b.column(3)):
                own = (d[at].astype(np.int64) << 32) | (position[at].astype(np.int64) << 16) | entry[at]
                order = np.argsort(own, kind="stable")
                keys, starts = np.unique(own[order], return_index=True)
                many = np.diff(np.append(starts, len(order)))
                # the count is the first number of each line
                lines = np.column_stack([many, np.add.reduceat(v[order].astype(np.int64), starts, axis=0)]) if len(order) else []
                for key, line in zip(keys.tolist(), lines, strict=True):
                    k = (key >> 32, key >> 16 & 0xFFFF, key & 0xFFFF)
                    sums[k] = sums[k] + line if k in sums else line
        keys = list(sums)
        yield pa.record_batch([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["d", "position", "entry", "sums"])

    lines = members.select("d", "position", "entry", "part").mapInArrow(run, "d int, position int, entry int, sums array<long>")
    by_place = lines.select("d", "position", "entry", F.posexplode("sums").alias("i", "x")).groupBy("d", "position", "entry", "i").agg(F.sum("x").alias("x"))
    total = {d: [np.zeros((n, w + 1), np.int64) for n, w in own] for d, own in shapes.items()}
    for r in by_place.collect():
        total[r["d"]][r["position"]][r["entry"], r["i"]] = r["x"]
    return {d: [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), old) for t, old in zip(total[d], books[d], strict=True)] for d in books}


def learn(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, salts: int = SALTS) -> Books:
    """Codebooks by length of the vectors (columns vec_id and v, as whole_vectors gives them), which should be stored."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries lie in 1 to 256, parts are positive")
    spark = vectors.sparkSession
    ship(spark)
    books = first_entries(vectors, entries, parts)
    if not books or rounds < 1:
        return books
    # an owner has PER_OWNER rows at most on average, even if one entry holds all parts of a position
    owners = max(salts, -(-vectors.count() // PER_OWNER))

    def sent_to_owners(moving: DataFrame) -> DataFrame:
        return moving.repartition("d", "position", "entry", F.pmod(F.xxhash64("row"), F.lit(owners))).drop("moved")

    rows = vectors.select(F.xxhash64("vec_id", F.monotonically_increasing_id()).alias("row"), "v")
    def home(members: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = fresh_dir(spark, name)
        members.write.parquet(path)
        return path, spark.read.schema(MEMBER).parquet(path)

    homes = [home(sent_to_owners(_assign(rows, books, True)), "members")]
    for turn in range(1, rounds + 1):
        members = homes[0][1] if len(homes) == 1 else homes[0][1].union(homes[1][1])
        books = _means(members, books)
        if turn == rounds:
            break
        path = fresh_dir(spark, "members")
        assigned = _assign(members, books, False)
        assigned.write.partitionBy("moved").parquet(path)
        both = spark.read.schema(assigned.schema).parquet(path)
        arrived = home(sent_to_owners(both.filter("moved")), "arrived")
        for old, _ in homes:
            remove(spark, old)
        homes = [(path, both.filter("NOT moved").drop("moved")), arrived]
    for old, _ in homes:
        remove(spark, old)
    return books


def encode(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance), by one scan of the vectors."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    from pyspark.sql import types as T

    frame = vectors.select("vec_id", "label", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in _rows(b.column(2)):
                done = [nearest(p, sent.value[v.shape[1]][i]) for i, p in enumerate(cut(v, len(sent.value[v.shape[1]])))]
                code = np.stack([entry for entry, _ in done], 1).astype(np.uint8)
                error = sum(far for _, far in done)
                own = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([c.tobytes().hex() for c in code]), pa.array(error), pa.array(np.full(len(at), v.shape[1], np.int32))], ["vec_id", "label", "code", "error", "d"])

    new = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType()), T.StructField("d", T.IntegerType())]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:2], *new]))


def decode(codes: DataFrame, books: Books, code: str = "code", d: str = "d", into: str = "v") -> DataFrame:
    """codes plus the vector of whole numbers that each code stands for; null codes give null."""
    from pyspark.sql import types as T

    sent = codes.sparkSession.sparkContext.broadcast(books)
    kept = [c for c in codes.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            made = [None if c is None or k is None else np.concatenate([sent.value[k][p][e] for p, e in enumerate(bytes.fromhex(c))])[:k].tolist() for c, k in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(made, pa.list_(pa.int32()))], [*kept, into])

    frame = codes.select(*[codes[c] for c in kept], codes[code].alias("__code"), codes[d].alias("__d"))
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[:-2], T.StructField(into, T.ArrayType(T.IntegerType()))]))


def digest(books: Books) -> dict[int, str]:
    """sha256 of all entries' decimal components by part, entry and place, joined by commas; by length."""
    return {d: hashlib.sha256(",".join(str(int(x)) for b in own for x in b.reshape(-1)).encode()).hexdigest() for d, own in books.items()}


def with_label_error(coded: DataFrame, salts: int = 64) -> DataFrame:
    """coded plus label_error, the sum of error over the rows of equal label (nulls together). The few lines of sums
    are repeated per salt, so that a label with most rows is met by many tasks."""
    salt = F.pmod(F.xxhash64("vec_id", "code", "error"), F.lit(salts))
    key = [F.coalesce(F.xxhash64("label"), F.lit(0)).alias("k"), F.col("label").isNull().alias("k_null")]
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("other"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    sums = sums.select("other", "label_error", "salt", F.xxhash64("other").alias("k"), F.col("other").isNull().alias("k_null"))
    left = coded.select("*", *key, salt.cast("int").alias("salt"))
    return left.join(sums, ["k", "k_null", "salt"]).filter(F.col("label").eqNullSafe(F.col("other"))).drop("k", "k_null", "salt", "other")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = stored(whole_vectors(load(spark, sf_dir, "embeddings", spread=True)), "vectors")
    books = learn(vectors, parts=8, entries=16, rounds=6)
    said = F.lit(None).cast("string")
    for d, sha in digest(books).items():
        said = F.when(F.col("d") == d, sha).otherwise(said)
    done = with_label_error(stored(encode(vectors, books), "codes"))
    discard(vectors)
    return done.select("vec_id", "code", "error", "label_error", said.alias("codebooks_sha256"))


def _round(r: int) -> str:
    """SQL of one assignment of all parts to codebook r-1, and of codebook r."""
    return f"""
a{r} AS MATERIALIZED (SELECT n, p, arg_min(e, (far, e)) AS e, min(far) AS far FROM (
    SELECT x.n, x.p, b.e, sum((x.x - b.c) * (x.x - b.c)) AS far FROM parts x JOIN b{r - 1} b ON b.p = x.p AND b.i = x.i GROUP BY ALL) GROUP BY n, p),
b{r} AS MATERIALIZED (SELECT o.p, o.e, o.i, coalesce(m.c, o.c) AS c FROM b{r - 1} o LEFT JOIN (
    SELECT x.p, a.e, x.i, ((sum(x.x) - ((sum(x.x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
    FROM parts x JOIN a{r} a ON a.n = x.n AND a.p = x.p GROUP BY ALL) m ON m.p = o.p AND m.e = o.e AND m.i = o.i),"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS n, vec_id, label,
                  list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT n, unnest(e) AS x, unnest(range(len(e))) AS i, len(e) // 8 AS wide FROM v),
parts AS MATERIALIZED (SELECT n, i // wide AS p, i % wide AS i, x FROM flat),
b0 AS MATERIALIZED (SELECT p, n AS e, i, x AS c FROM parts WHERE n < 16),
{"".join(map(_round, range(1, 8)))}
sha AS (SELECT sha256(string_agg(c, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b6),
coded AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM a7 GROUP BY n)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN v USING (n), sha
"""
