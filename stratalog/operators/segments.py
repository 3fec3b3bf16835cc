"""Sections at jumps, branch points by similarity, segments, and distances between segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signatures import placed, set_distance, shared_bands, tiered_distance
from ..schemas import PARAMS
from ..session import stage


def sections(hashes: DataFrame, jump: int = PARAMS.jump) -> DataFrame:
    """(room, section, start_sg, end_sg): a section starts at a room's first group and after that at each jump."""
    return section_ends(section_of(hashes, jump))


def section_of(hashes: DataFrame, jump: int = PARAMS.jump) -> DataFrame:
    """(room, sg, section)."""
    order = Window.partitionBy("room").orderBy("sg")
    first = F.row_number().over(order) == 1
    rows = hashes.withColumn("starts", (first | (F.col("add_count") + F.col("gone_count") > jump)).cast("int"))
    return rows.select("room", "sg", (F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("section"))


def section_ends(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("room", "section").agg(F.min("sg").alias("start_sg"), F.max("sg").alias("end_sg"))


def labels(hashes: DataFrame) -> DataFrame:
    """(room, sg, section, segment, past, past_similarity, future, future_similarity, branch): what ``sections``, ``branch_points``, ``segments`` and ``branches`` find, a row a group."""
    part = stage(section_of(hashes), "section-of")
    parts = section_ends(part)
    past, future = (stage(branch_points(probes_of(parts, hashes, side), hashes, side), "branch-points") for side in (True, False))
    out = part.join(segments(hashes, parts, past, future), ["room", "sg"])
    for name, found in (("past", past), ("future", future)):
        out = out.join(found.select("room", F.col("probe").alias("sg"), F.col("match").alias(name), F.col("similarity").alias(f"{name}_similarity")), ["room", "sg"], "left")
    return out.join(branches(hashes).withColumnRenamed("start", "sg"), ["room", "sg"], "left").select("room", "sg", "section", "segment", "past", "past_similarity", "future", "future_similarity", "branch")


def _best(probes: DataFrame, hashes: DataFrame, column: str, past: bool, min_shared: int) -> DataFrame:
    """(room, probe, match, similarity): the most similar earlier (later) group that shares a value of ``column``.

    Probes are two a section; they meet candidates by an equi-join on single values, not by comparing all groups.
    """
    p = probes.select("room", F.col("sg").alias("probe"), F.size("minhash").alias("n"), placed(F.col("minhash")).alias("p_placed"), F.col(column).alias("p_values"))
    keyed = p.select("room", "probe", F.explode(F.array_distinct("p_values")).alias("value"))
    values = hashes.select("room", "sg", F.explode(F.array_distinct(column)).alias("value"))
    side = F.col("sg") < F.col("probe") if past else F.col("sg") > F.col("probe")
    pairs = keyed.join(values, ["room", "value"]).where(side).select("room", "probe", "sg").distinct()
    found = hashes.select("room", "sg", placed(F.col("minhash")).alias("placed"), F.col(column).alias("values"))
    full = pairs.join(found, ["room", "sg"]).join(p, ["room", "probe"])  # the probes, fewer, come last, so pairs are dealt as bare ids
    if min_shared > 1:
        full = full.where(shared_bands(F.col("values"), F.col("p_values")) >= min_shared)
    full = full.select("room", "probe", "sg", (F.size(F.array_intersect("placed", "p_placed")) / F.col("n")).alias("similarity"))
    rank = F.struct("similarity", F.col("sg") if past else -F.col("sg"))
    return full.groupBy("room", "probe").agg(F.max_by("sg", rank).alias("match"), F.max("similarity").alias("similarity"))


def branch_points(probes: DataFrame, hashes: DataFrame, past: bool, min_shared: int = PARAMS.min_bands, fallback: bool = True) -> DataFrame:
    """As ``_best`` by bands; probes without any such group are tried again by single minhash values."""
    found = _best(probes, hashes, "lsh_bands", past, min_shared)
    if not fallback:
        return found
    found = stage(found, "branch-points")
    missed = stage(probes.join(found.select("room", F.col("probe").alias("sg")), ["room", "sg"], "left_anti"), "missed")
    reach = missed.groupBy("room").agg((F.max if past else F.min)("sg").alias("reach"))  # groups beyond it fit no missed probe
    fits = F.col("sg") < F.col("reach") if past else F.col("sg") > F.col("reach")
    return found.unionByName(_best(missed, hashes.join(reach, "room").where(fits).drop("reach"), "minhash", past, 1))


def probes_of(parts: DataFrame, hashes: DataFrame, past: bool) -> DataFrame:
    """Signature rows of the section starts (to look for a past match) or ends (for a future one)."""
    column = "start_sg" if past else "end_sg"
    return hashes.join(parts.select("room", F.col(column).alias("sg")), ["room", "sg"], "left_semi")


def segments(hashes: DataFrame, parts: DataFrame, past: DataFrame, future: DataFrame) -> DataFrame:
    """(room, sg, segment): cuts after each section's end, after each past match, and before each future match."""
    order = Window.partitionBy("room").orderBy("sg")
    rows = hashes.select("room", "sg").withColumn("before", F.lag("sg").over(order))
    cuts = parts.select("room", F.col("end_sg").alias("sg")).union(past.select("room", F.col("match").alias("sg")))
    cuts = cuts.distinct().withColumn("cut", F.lit(1))
    starts = future.select("room", F.col("match").alias("sg")).distinct().withColumn("opens", F.lit(1))
    rows = rows.join(cuts, ["room", "sg"], "left").join(starts, ["room", "sg"], "left")
    cut_before = F.coalesce(F.lag("cut").over(order), F.lit(0))
    new = (F.coalesce(F.col("opens"), F.lit(0)) + cut_before > 0).cast("int")
    first = F.col("before").isNull()
    rows = rows.withColumn("new", F.when(first, 0).otherwise(new))
    return rows.select("room", "sg", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("segment"))


def segment_ends(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("room", "segment").agg(F.min("sg").alias("start_sg"), F.max("sg").alias("end_sg"))


def segment_signatures(labelled: DataFrame, hashes: DataFrame) -> DataFrame:
    """(room, segment, end_minhash, end_bands, start_minhash, start_bands): what the distances of a room's segments follow from."""
    ends = segment_ends(labelled)
    for at in ("end", "start"):
        sig = hashes.select("room", F.col("sg").alias(f"{at}_sg"), F.col("minhash").alias(f"{at}_minhash"), F.col("lsh_bands").alias(f"{at}_bands"))
        ends = ends.join(sig, ["room", f"{at}_sg"])
    return ends.drop("start_sg", "end_sg")


def segment_distance(labelled: DataFrame, hashes: DataFrame) -> DataFrame:
    """(room, i, j, distance): from the end of segment i to the start of segment j; 0 from a segment to itself.

    Per room a stated matrix of segments, for export; the solvers take the signatures and make it themselves.
    """
    sig = segment_signatures(labelled, hashes)
    one = sig.select("room", F.col("segment").alias("i"), F.col("end_minhash").alias("m1"), F.col("end_bands").alias("b1"))
    two = sig.select("room", F.col("segment").alias("j"), F.col("start_minhash").alias("m2"), F.col("start_bands").alias("b2"))
    d = tiered_distance(F.col("b1"), F.col("b2"), F.col("m1"), F.col("m2"))
    return one.join(two, "room").select("room", "i", "j", F.when(F.col("i") == F.col("j"), 0).otherwise(d).cast("long").alias("distance"))


def neighbour_distance(hashes: DataFrame) -> DataFrame:
    """(room, sg, next_sg, distance): band distance of neighbours in order."""
    order = Window.partitionBy("room").orderBy("sg")
    rows = hashes.select("room", "sg", "lsh_bands", F.lead("sg").over(order).alias("next_sg"), F.lead("lsh_bands").over(order).alias("next"))
    return rows.where("next_sg is not null").select("room", "sg", "next_sg", set_distance(F.col("lsh_bands"), F.col("next")).cast("long").alias("distance"))


def branches(hashes: DataFrame, jump: int = PARAMS.branch_jump, min_bands: int = PARAMS.branch_bands) -> DataFrame:
    """(room, start, branch): jumps that have an earlier look-alike, and that look-alike."""
    probes = hashes.where(F.col("add_count") + F.col("gone_count") > jump)
    found = _best(probes, hashes, "lsh_bands", True, min_bands)
    return found.select("room", F.col("probe").alias("start"), F.col("match").alias("branch"))


def branch_fill(hashes: DataFrame, found: DataFrame) -> DataFrame:
    """(room, sg, branch): each group's branch is the last one that started; before the first, the room's first group."""
    order = Window.partitionBy("room").orderBy("sg")
    rows = hashes.select("room", "sg").join(found.withColumnRenamed("start", "sg"), ["room", "sg"], "left")
    last = F.last("branch", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("room", "sg", F.coalesce(last, F.min("sg").over(Window.partitionBy("room"))).alias("branch"))


def range_assign(groups: DataFrame, ranges: DataFrame) -> DataFrame:
    """(room, sg, segment) by start_sg <= sg <= end_sg of disjoint ``ranges``; starts are merged into the order instead of a theta-join."""
    marks = groups.select("room", "sg", F.lit(None).cast("struct<segment:bigint,end_sg:bigint>").alias("r"))
    starts = ranges.select("room", F.col("start_sg").alias("sg"), F.struct(F.col("segment").cast("long").alias("segment"), "end_sg").alias("r"))
    rows = marks.withColumn("own", F.lit(1)).unionByName(starts.withColumn("own", F.lit(0)))
    order = Window.partitionBy("room").orderBy("sg", "own").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("r", F.last("r", ignorenulls=True).over(order)).where("own = 1 and sg <= r.end_sg")
    return rows.select("room", "sg", F.col("r.segment").alias("segment"))
