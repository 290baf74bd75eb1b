"""Mixing sources to target weights: hierarchical token budgets and seeded token-prefixes.

The tree's levels are columns (domain, language, source). A node splits its budget among its
children by weight; a child that cannot use its share (its supply times the allowed epochs is
smaller) takes what it has, and the shortage goes to its siblings by weight. Only what a whole
subtree cannot use rises to the next ancestor's other children. All of this is exact (fractions,
then whole tokens by largest remainder) over one row per leaf, the size of the weight table.

A leaf with budget B and supply S takes B div S whole epochs and the prefix of the next one whose
tokens add up to B mod S at most. The order of an epoch is the 60-bit number at the head of
md5(seed|epoch|doc_id), then doc_id, then the text's hash. The prefix is found from sums over slices
of that order, 2**BITS a level, down to slices of about BUCKET rows, one of which per leaf is read
closely; so no leaf is ever sorted or summed in one task, and texts are never shuffled.

Edge cases: null path columns form a child called ``null``; null and empty texts have no tokens and
belong to every prefix their place falls in; rows equal in everything are taken together; weights
missing for a child count as 1, a child of weight 0 gets nothing; an empty table or a budget of 0
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, load, stored

BUCKET, BITS = 512, 8
BROADCAST_LEAVES = 50_000
Path = tuple[str, ...]


def water_fill(budget: Fraction, caps: Mapping[str, int], weights: Mapping[str, Fraction]) -> dict[str, Fraction]:
    """Shares by weight, none above its cap; what capped children leave goes to the others."""
    given = {k: Fraction(0) for k in caps}
    open_ = {k for k in caps if weights[k] > 0 and caps[k] > 0}
    left = Fraction(budget)
    while open_ and left > 0:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if caps[k] - given[k] <= left * weights[k] / total}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            return given
        for k in full:
            left -= caps[k] - given[k]
            given[k] = Fraction(caps[k])
        open_ -= full
    return given


def whole(shares: Mapping, total: int) -> dict:
    """Whole numbers below total by largest remainder; ties go to the smaller key."""
    out = {k: int(v) for k, v in shares.items()}
    rest = int(min(total, sum(shares.values()))) - sum(out.values())
    for k in sorted(shares, key=lambda k: (-(shares[k] - out[k]), k))[: max(0, rest)]:
        out[k] += 1
    return out


def allocate(supply: Mapping[Path, int], weights: Mapping[Path, float], budget: int, epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. weights has the weight of any node by its path; 1 where it has none."""
    if not supply:
        return {}
    # every node's supply and children, once from the leaves up
    caps: dict[Path, int] = {}
    below: dict[Path, list[str]] = {}
    for p, n in supply.items():
        for depth in range(len(p) + 1):
            node = p[:depth]
            if depth and node not in caps:
                below.setdefault(node[:-1], []).append(node[-1])
            caps[node] = caps.get(node, 0) + n * epochs
    given: dict[Path, Fraction] = {}
    open_: list[tuple[Path, Fraction]] = [((), Fraction(budget))]
    while open_:
        node, amount = open_.pop()
        if node in supply:
            given[node] = amount
            continue
        kids = sorted(below[node])
        shares = water_fill(amount, {k: caps[*node, k] for k in kids}, {k: Fraction(str(weights.get((*node, k), 1))) for k in kids})
        open_ += [((*node, k), v) for k, v in shares.items()]
    return {p: min(n, supply[p] * epochs) for p, n in whole(given, budget).items()}


def tokens(text: str = "text"):
    """White-space words of a text column; null has none."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+")) - F.when(t.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def _order(seed: int, epoch):
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, levels: Sequence, weights: Mapping[Path, float], budget: int | float, epochs: int = 1, seed: int = 0, bucket: int = BUCKET) -> DataFrame:
    """docs once for each epoch that takes them, plus ``epoch``.

    levels: columns of the path. budget: tokens, or if a float at most 1 a part of the supply.
    """
    spark = docs.sparkSession
    path = F.struct(*[F.coalesce(c.cast("string"), F.lit("null")).alias(f"l{i}") for i, c in enumerate(levels)])
    tie = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("x"))
    # ids, places and token counts without texts, read several times below
    lean = stored(docs.select(path.alias("leaf"), "doc_id", tie.alias("tie"), tokens().alias("n")), "mixing")
    leaves = lean.groupBy("leaf").agg(F.sum("n").alias("supply"), F.count("*").alias("rows")).collect()
    supply = {tuple(r["leaf"]): r["supply"] for r in leaves}
    total = sum(supply.values())
    given = allocate(supply, weights, int(budget * total) if isinstance(budget, float) else budget, epochs)
    plan, most = [], 1
    for r in leaves:
        p, s = tuple(r["leaf"]), r["supply"]
        full, rest = divmod(given[p], s) if s else (0, 0)
        plan.append((p, int(full), int(rest)))
        most = max(most, r["rows"] if rest else 1)
    shape = f"leaf struct<{', '.join(f'l{i}: string' for i in range(len(levels)))}>, full int, rest long"
    told = spark.createDataFrame(plan, shape)
    near = F.broadcast if len(plan) <= BROADCAST_LEAVES else (lambda d: d)

    # the last, partial epoch: its order's leading bits, a level at a time, down to the slice in which
    # each leaf's budget ends; a leaf gives at most 2**BITS sums a level
    last = lean.join(near(told.filter("rest > 0")), "leaf").withColumn("h", _order(seed, F.col("full")))
    ends, depth = None, 0
    while depth == 0 or (most >> BITS * depth > bucket and BITS * (depth + 1) <= 60):
        inside = last.withColumn("begin", F.lit(0).cast("long")) if ends is None else last.join(near(ends), "leaf").filter(F.shiftright("h", 60 - BITS * depth) == F.col("slice"))
        depth += 1
        sums = inside.groupBy("leaf", "rest", "begin", F.shiftright("h", 60 - BITS * depth).alias("b")).agg(F.sum("n").alias("n"))
        edge = sums.withColumn("end", F.col("begin") + F.sum("n").over(Window.partitionBy("leaf").orderBy("b")))
        # the first slice that does not fit as a whole
        found = edge.filter("end > rest").groupBy("leaf").agg(F.min(F.struct("b", (F.col("end") - F.col("n")).alias("begin"))).alias("at"))
        ends = stored(found.select("leaf", F.col("at.b").alias("slice"), F.col("at.begin").alias("begin")), "ends")
    close = last.join(near(ends), "leaf").filter(F.shiftright("h", 60 - BITS * depth) == F.col("slice"))
    running = Window.partitionBy("leaf").orderBy("h", "tie").rangeBetween(Window.unboundedPreceding, 0)
    fits = close.withColumn("cum", F.sum("n").over(running) + F.col("begin")).filter("cum <= rest").groupBy("leaf").agg(F.max(F.struct("h", "tie")).alias("cut"))
    cuts = stored(told.join(ends.select("leaf", "slice"), "leaf", "left").join(fits, "leaf", "left").select("leaf", "full", "rest", F.col("slice").alias("edge"), "cut"), "cuts")
    discard(lean)

    marked = docs.withColumns({"__leaf": path, "__tie": tie}).join(near(cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns])), "__leaf")
    h = _order(seed, F.col("__full"))
    b = F.shiftright(h, 60 - BITS * depth)
    partial = (F.col("__rest") > 0) & (F.col("__edge").isNull() | (b < F.col("__edge")) | ((b == F.col("__edge")) & (F.struct(h.alias("h"), F.col("__tie").alias("tie")) <= F.col("__cut"))))
    count = F.col("__full") + F.when(F.coalesce(partial, F.lit(False)), 1).otherwise(0)
    out = marked.withColumn("__times", count).filter("__times > 0")
    if epochs == 1:
        done = out.withColumn("epoch", F.lit(0))
    else:
        done = out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
    return done.drop("__leaf", "__tie", "__full", "__rest", "__edge", "__cut", "__times")


def levels_of(source: str = "source", lang: str = "lang") -> list:
    """Domain (a third of the sources each, by checksum), language, source."""
    domain = F.concat(F.lit("domain"), (F.crc32(F.coalesce(F.col(source), F.lit(""))) % 3).cast("string"))
    return [domain, F.col(lang), F.col(source)]


#: Target weights of the domains and, within each, of English; siblings without a weight count 1.
WEIGHTS: dict[Path, float] = {("domain0",): 3, ("domain1",): 2, ("domain2",): 1, **{(f"domain{d}", "en"): 2 for d in range(3)}}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    mixed = mix(docs, levels_of(), WEIGHTS, 0.75, epochs=2, seed=6)
    domain, lang, source = levels_of()
    return mixed.select("doc_id", domain.alias("domain"), lang.alias("lang"), source.alias("source"), tokens().alias("n_tokens"), "epoch")
