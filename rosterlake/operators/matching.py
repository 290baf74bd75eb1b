"""Resolving names to facilities, people across facilities, and duplicate facilities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import alike, geo, similarity
from rosterlake.functions.geo import haversine_km
from rosterlake.functions.rounding import rounded
from rosterlake.functions.text import facility_name
from rosterlake.sources.staging import stored

MATCH, DUPLICATE, REVIEW, NEAR_KM = 80.0, 85.0, 70.0, 1.5

ANY = "any"
#: Names of a block of the asked and of the known side: a task holds one of each.
ASKED_BLOCK, KNOWN_BLOCK = 8_000, 50_000
#: Facilities of the first batch of a greedy pass.
BATCH = 25_000


def _met(asked: DataFrame, known: DataFrame, result: Callable, schema: str) -> DataFrame:
    """result of asked (scope, n, floor, whole) and known (scope, n, ...) names, a block of each side of a scope at a time.

    Names are dealt to blocks by their hash, so no scope or name makes a block large, and each block of the one side meets
    each of the other.
    """

    def counted(side: DataFrame, size: int, name: str) -> DataFrame:
        return side.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias(name))

    grid = counted(asked, ASKED_BLOCK, "across").join(counted(known, KNOWN_BLOCK, "down"), "scope")

    def dealt(side: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        placed = side.withColumn("tokens", similarity.sorted_tokens(F.col("n"))).join(grid, "scope").withColumn(own, F.pmod(F.xxhash64("n"), F.col(own_blocks)).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1))).drop("across", "down")
        return placed.toDF(*placed.columns)  # columns of its own, for a side that meets itself

    left, right = dealt(asked, "column", "across", "row", "down"), dealt(known, "row", "down", "column", "across")
    return left.groupBy("scope", "row", "column").cogroup(right.groupBy("scope", "row", "column")).applyInPandas(result, schema)


def _checked(threshold: float) -> float:
    if not 0 < threshold <= 100:
        raise ValueError("a threshold lies above 0, up to 100")
    return float(threshold)


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(scope, n, other, score) of the pairs of names n of left and right, within a scope, that score the threshold or more.

    Both sides have scope and n, and repeats among them meet once. Within a block, the names of one length are walked
    by their prefixes, and a name leaves a prefix that cannot come to the common subsequence that the threshold asks for.
    """
    asked = left.select("scope", "n").filter("n <> ''").distinct().withColumns({"floor": F.lit(_checked(threshold)), "whole": F.lit(False)})
    return _met(asked, right.select("scope", "n").filter("n <> ''").distinct(), alike.all_pairs, "scope string, n string, other string, score double")


def best_names(asked: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(scope, n, score, id) of the best known name (distinct scope and n, id) of each asked one (scope, n), at the threshold or above.

    The names that hold the asked one whole, or that it holds, come first: few pairs, and their best score is a floor
    for the second walk, which looks at all names. Equal scores go to the smaller id.
    """
    threshold = _checked(threshold)
    asked = asked.select("scope", "n").filter("n <> ''").distinct()

    def walked(floors: DataFrame) -> DataFrame:
        met = _met(floors, known, alike.best_pairs, "scope string, n string, score double, id long")
        best = met.groupBy("scope", "n").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("b"))
        return best.select("scope", "n", F.col("b.score").alias("score"), (-F.col("b.minus")).alias("id"))

    first = stored(walked(asked.withColumns({"floor": F.lit(threshold), "whole": F.lit(True)})).select("scope", "n", F.col("score").alias("floor")))
    return walked(asked.join(first, ["scope", "n"], "left").withColumns({"floor": F.coalesce("floor", F.lit(threshold)), "whole": F.lit(False)}))


def fuzzy_best(names: DataFrame, facilities: DataFrame, threshold: float = MATCH) -> DataFrame:
    """names (key, raw, grp) with the best facility of the group (any, if grp is null), its score.

    Distinct (raw, grp) are matched once. Equal normalised names score 100 and are settled by an equi-join; the others
    go through best_names, where a group is a scope. Equal scores go to the smaller id.
    """
    scope = F.when(F.col("grp").isNull(), ANY).otherwise(F.concat(F.lit("="), "grp"))
    asked = names.select("raw", "grp").distinct().select("raw", "grp", scope.alias("scope"), facility_name(F.col("raw")).alias("n")).filter("n <> ''")
    known = facilities.select("id", "grp", facility_name(F.col("name")).alias("n")).filter("n <> ''")
    # a name is known to everyone, and within its group where it has one (no array to explode: where every group is
    # a null constant, the optimizer loses a column of the joins below it)
    within = known.filter("grp IS NOT NULL").withColumn("scope", F.concat(F.lit("="), "grp"))
    known = known.withColumn("scope", F.lit(ANY)).unionByName(within).groupBy("scope", "n").agg(F.min("id").cast("long").alias("id"))
    # written once: the walks below read both sides many times
    known = stored(known)
    asked = stored(asked.join(known, ["scope", "n"], "left"))
    exact = asked.filter("id IS NOT NULL").select("raw", "grp", "id", F.lit(100.0).alias("score"))
    open_ = asked.filter("id IS NULL").drop("id")
    found = open_.join(best_names(open_, known, threshold), ["scope", "n"]).select("raw", "grp", "id", "score")
    found = exact.unionByName(found).select(F.col("raw").alias("b_raw"), F.col("grp").alias("b_grp"), "id", rounded(F.col("score"), 4).alias("score"))
    return names.join(found, (F.col("raw") == F.col("b_raw")) & F.col("grp").eqNullSafe(F.col("b_grp")), "left").select("key", "raw", "grp", "id", "score")


def cascade(names: DataFrame, facilities: DataFrame, point_alias: DataFrame, name_alias: DataFrame, threshold: float = MATCH) -> DataFrame:
    """Resolution in order: an alias to a point, an alias to a name, then the fuzzy match.

    point_alias: raw, lat, lon. name_alias: raw, target. A name alias that hits one facility exactly
    wins; more than one is no match at all; none goes on to the fuzzy match with the target's name.
    """
    points = point_alias.join(facilities.select("id", "lat", "lon").withColumnsRenamed({"lat": "f_lat", "lon": "f_lon"}), (F.abs(F.col("lat") - F.col("f_lat")) < 0.0005) & (F.abs(F.col("lon") - F.col("f_lon")) < 0.0005))
    by_point = points.groupBy("raw").agg(F.min("id").alias("point_id"))
    f = facilities.select("id", facility_name(F.col("name")).alias("f_n"))
    hits = name_alias.withColumn("n", facility_name(F.col("target"))).join(f, F.col("n") == F.col("f_n"), "left")
    by_name = hits.groupBy("raw").agg(F.count("id").alias("hits"), F.min("id").alias("name_id"), F.first("target").alias("target"))
    told = stored(names.join(by_point, "raw", "left").join(by_name, "raw", "left"))  # read four times
    settled = told.filter(F.col("point_id").isNotNull() | (F.coalesce("hits", F.lit(0)) >= 1))
    done = settled.select("key", "raw", "grp", F.coalesce("point_id", F.when(F.col("hits") == 1, F.col("name_id"))).alias("id"), F.when(F.col("point_id").isNotNull(), "point alias").when(F.col("hits") == 1, "name alias").otherwise("ambiguous").alias("how"))
    open_ = told.filter(F.col("point_id").isNull() & (F.coalesce("hits", F.lit(0)) == 0)).select("key", F.coalesce("target", "raw").alias("raw"), "grp", F.col("raw").alias("own"))
    fuzzy = fuzzy_best(open_.select("key", "raw", "grp"), facilities, threshold).join(open_.select("key", "own"), "key")
    return done.unionByName(fuzzy.select("key", F.col("own").alias("raw"), "grp", "id", F.when(F.col("id").isNotNull(), "fuzzy").otherwise("none").alias("how")))


def external_facilities(links: DataFrame) -> DataFrame:
    """facility, people with a place elsewhere, their mean number of other facilities (null if none)."""
    each = links.select("facility", "person").distinct()
    spread = each.groupBy("person").agg((F.count("*") - 1).alias("other"))
    per = each.join(spread, "person").groupBy("facility").agg(F.count_if(F.col("other") > 0).alias("n"), F.sum("other").alias("total"))
    n = F.nullif(F.col("n"), F.lit(0))
    return per.select("facility", n.alias("shared_people"), rounded(F.col("total") / n, 2).alias("mean_other"))


def candidate_pairs(later: DataFrame, earlier: DataFrame, floor: float = REVIEW, km: float = NEAR_KM, off_map: bool = True) -> DataFrame:
    """(b, a, score) of later and earlier facilities, a before b, that score the floor or more and are not far apart.

    Both sides have ordinal, lat, lon, n, tokens (n with its words in order). Facilities on the map meet in grid cells at
    least km wide (own and neighbouring cells); the ones off the map (off_map: there may be some) meet all of like names,
    by similar_names.
    """
    other = earlier.select(*[F.col(x).alias(f"a_{x}") for x in ("ordinal", "lat", "lon", "n", "tokens")])
    mapped, near = F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("a_lat").isNotNull() & F.col("a_lon").isNotNull()
    met = geo.meet(later.filter(mapped), other.filter(near), "lat", "lon", "a_lat", "a_lon", km).filter(F.col("a_ordinal") < F.col("ordinal"))
    met = met.filter(similarity.ceiling(F.col("n"), F.col("a_n")) >= floor).withColumn("score", similarity.scores(F.col("n"), F.col("a_n"), F.col("tokens"), F.col("a_tokens"))).filter(F.col("score") >= floor)
    found = met.select(F.col("ordinal").alias("b"), F.col("a_ordinal").alias("a"), "score")
    if not off_map:
        return found

    def loose(left: DataFrame, right: DataFrame) -> DataFrame:
        names = similar_names(left.select(F.lit(ANY).alias("scope"), "n"), right.select(F.lit(ANY).alias("scope"), F.col("a_n").alias("n")), floor).select("n", "other", "score")
        ends = left.select(F.col("ordinal").alias("b"), "n").join(names, "n").join(right.select(F.col("a_ordinal").alias("a"), F.col("a_n").alias("other")), "other")
        return ends.filter("a < b").select("b", "a", "score")

    return found.unionByName(loose(later.filter(~mapped), other)).unionByName(loose(later.filter(mapped), other.filter(~near)))


def _last_ordinals(f: DataFrame) -> list[int | None]:
    """The last ordinal of each batch of a greedy pass: the first BATCH facilities, then as many as came before."""
    n, cuts = f.count(), []
    while n > BATCH << len(cuts):
        cuts.append((BATCH << len(cuts)) / n)
    return [*sorted(set(f.select(F.percentile_approx("ordinal", cuts, 10_000)).first()[0])), None] if cuts else [None]


def greedy_dedup(facilities: DataFrame, floor: float = REVIEW, threshold: float = DUPLICATE, km: float = NEAR_KM) -> DataFrame:
    """ordinal, kept ordinal it merged into (itself if kept), review ordinal (a kept one just below).

    In input order each facility joins the best kept one at or above the threshold, else it is kept;
    a best score from floor on is a review note. A repeated ordinal is one facility of several names or places.

    A facility meets kept ones only: the pass goes in batches, each as large as all before it. What meets a kept one of an
    earlier batch at the threshold is not kept. Among the others of the batch, rounds keep each whose smaller ones at the
    threshold are all not kept; the smallest open one always is, so the rounds end by themselves.
    """
    cut = stored  # each step is a written table, so lineage stays short and lost executors cost nothing

    name = facility_name(F.col("name"))
    f = cut(facilities.select("ordinal", "lat", "lon", name.alias("n"), similarity.sorted_tokens(name).alias("tokens")).filter("n <> ''"))
    off_map = not f.filter("lat IS NULL OR lon IS NULL").isEmpty()
    parts = 3 * f.sparkSession.sparkContext.defaultParallelism

    def met(later: DataFrame, earlier: DataFrame, least: float) -> DataFrame:
        return candidate_pairs(later.repartition(parts, "ordinal"), earlier, least, km, off_map)

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("minus"))).alias("best"))

    kept: DataFrame | None = None
    bests, before = [], None
    for last in _last_ordinals(f):
        batch = f
        if before is not None:
            batch = batch.filter(F.col("ordinal") > before)
        if last is not None:
            batch = batch.filter(F.col("ordinal") <= last)
        before, open_ = last, batch
        if kept is not None:
            bests.append(cut(best(met(batch, kept, floor))))
            open_ = cut(batch.join(bests[-1].filter(F.col("best.score") >= threshold).select(F.col("b").alias("ordinal")), "ordinal", "left_anti"))
        pairs = cut(met(open_, open_, threshold).select("a", "b"))
        while not pairs.isEmpty():
            first = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")), "a", "left_anti")
            gone = cut(pairs.join(first, "a").select("b").distinct())
            open_ = open_.join(gone.withColumnRenamed("b", "ordinal"), "ordinal", "left_anti")
            pairs = cut(pairs.join(first, "a", "left_anti").join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti"))
        open_ = cut(open_)
        bests.append(cut(best(met(batch, open_, floor))))
        kept = open_ if kept is None else kept.unionByName(open_)
    found = reduce(DataFrame.unionByName, bests).groupBy(F.col("b").alias("ordinal")).agg(F.max("best").alias("best"))
    merges = F.coalesce(F.col("best.score") >= threshold, F.lit(False))
    told = facilities.select("ordinal").distinct().join(found, "ordinal", "left")
    return told.select("ordinal", F.when(merges, -F.col("best.minus")).otherwise(F.col("ordinal")).alias("into"), F.when(~merges, -F.col("best.minus")).alias("review"))


def group_match(name: Column, groups: list[str]) -> Column:
    """The first configured group whose name stands inside the facility's name, any case."""
    return F.get(F.filter(F.array(*[F.lit(g) for g in groups]), lambda g: F.contains(F.lower(name), F.lower(g))), 0)


def in_region(text: Column, allow: tuple[str, ...], deny: tuple[str, ...] = ()) -> Column:
    """Deny hints first, then allow hints, as substrings of any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    no = F.lit(False)
    for h in deny:
        no = no | low.contains(h)
    yes = F.lit(False)
    for h in allow:
        yes = yes | low.contains(h)
    return ~no & yes


def ownership(kind: Column) -> Column:
    return F.when(kind.isin("private", "private_non_profit"), "swasta").when(kind.isin("government", "public", "community"), "pemerintah")


def first_wins(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row of the smallest position for each key."""
    w = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def weekly_pattern(rows: DataFrame) -> DataFrame:
    """Dated bookings as weekly sessions: one per (record, day, start, end), rows without a day untouched."""
    dated = first_wins(rows.filter("day IS NOT NULL"), ["record", "day", "start_time", "end_time"], "position")
    return dated.unionByName(rows.filter("day IS NULL"))


def facility_only(label: Column, group: Column, excluded: tuple[str, ...]) -> Column:
    """A facility by its label: no excluded fragment, and a facility word or a preferred group."""
    low = F.lower(F.coalesce(label, F.lit("")))
    bad = F.lit(False)
    for x in excluded:
        bad = bad | low.contains(x)
    return ~bad & (low.rlike(r"\brs[a-z]*\b|rumah\s+sakit|\bhospital\b") | (F.coalesce(group, F.lit("")) != ""))


def resolve_overrides(overrides: DataFrame, facilities: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """(source id, target id) of overrides given as two points with names; both sides must resolve."""
    f = facilities.select("id", "name", "lat", "lon")

    def side(prefix: str) -> DataFrame:
        o = overrides.select("key", F.col(f"{prefix}.name").alias("o_name"), F.col(f"{prefix}.lat").alias("o_lat"), F.col(f"{prefix}.lon").alias("o_lon"))
        hit = o.join(f, (F.col("o_name") == F.col("name")) & (F.abs(F.col("o_lat") - F.col("lat")) < tolerance) & (F.abs(F.col("o_lon") - F.col("lon")) < tolerance))
        return hit.groupBy("key").agg(F.min("id").alias(f"{prefix}_id"))

    return side("source").join(side("target"), "key")



def display_alias(facilities: DataFrame, aliases: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """facilities (id, name, lat, lon, ...) plus display_alias. aliases (position, name, lat, lon, alias):
    each goes to the smallest id of its name at its place; of several for one facility the last one holds."""
    a = aliases.select("position", F.col("name").alias("a_name"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), "alias")
    near = (F.col("a_name") == F.col("name")) & (F.abs(F.col("a_lat") - F.col("lat")) < tolerance) & (F.abs(F.col("a_lon") - F.col("lon")) < tolerance)
    hit = a.join(facilities.select("id", "name", "lat", "lon"), near).groupBy("position", "alias").agg(F.min("id").alias("id"))
    return facilities.join(hit.groupBy("id").agg(F.max_by("alias", F.struct("position", "alias")).alias("display_alias")), "id", "left")


def group_override(facilities: DataFrame, overrides: DataFrame) -> DataFrame:
    """facilities with grp replaced where overrides (name, grp) has the normalised name; smallest grp on ties."""
    told = overrides.select(facility_name(F.col("name")).alias("__n"), F.col("grp").alias("__g")).groupBy("__n").agg(F.min("__g").alias("__g"))
    keyed = facilities.withColumn("__n", facility_name(F.col("name"))).join(told, "__n", "left")
    return keyed.withColumn("grp", F.coalesce("__g", "grp")).drop("__n", "__g")
