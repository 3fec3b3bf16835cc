"""Mixing sources to target weights by fitting each source's word budget as a subset sum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, Scratch, word_count

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix holds 3/2 of all words
MOST = 2  # times that one document is taken at most
PIECES = 256  # hash classes of one (source, size), so that none of them is ranked in one task


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, docs, target.

    Sources by code point, null last, take ``weights`` in turn.  A source is at its ceiling of twice its size if that is
    below what it would get once all sources with a smaller ratio of ceiling to weight are at theirs; the others share
    what is left by weight.  The windows run over one row a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    budget = (SHARE[0] * everything - SHARE[1] * MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / SHARE[1]
    w = w.withColumn("capped", MOST * F.col("source_size") * F.sum("weight").over(after) < budget * F.col("weight"))
    w = w.withColumn("all_size", everything)
    free = ~F.col("capped")
    capped_size = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(Window.partitionBy()), F.lit(0))
    free_weight = F.sum(F.when(free, F.col("weight"))).over(Window.partitionBy())
    rest = (SHARE[0] * F.col("all_size") - SHARE[1] * MOST * capped_size).cast("double")
    target = F.when(F.col("capped"), (MOST * F.col("source_size")).cast("double")).otherwise(rest * F.col("weight") / (SHARE[1] * free_weight).cast("double"))
    return w.withColumn("target", target).select("source", "source_size", "docs", "target")


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 4096) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to ``budget``, or to the sum nearest to it.

    First every length gets its even share, then a pass from the longest down takes what still fits.  If words are left
    over, documents are given back, the shortest first, and a bounded knapsack over all that is free then finds the sum
    nearest to the budget, above or below: reachable sums, with the last part that reached each.  While that misses the
    budget, twice as many words are given back, until nothing is left to give: then the result is the best of all
    subsets.  Lengths are divided by their common divisor.  Of two sums equally near the smaller one is taken.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    use = np.flatnonzero((lengths > 0) & (counts > 0))
    if budget <= 0 or not len(use):
        return taken
    unit = int(np.gcd.reduce(lengths[use]))
    order = use[np.argsort(-lengths[use], kind="stable")]
    size, n = (lengths[order] // unit).tolist(), counts[order].tolist()
    total = sum(a * b for a, b in zip(size, n))
    goal, over = divmod(budget, unit)  # the goal in units, and words beyond it
    if goal >= total:
        taken[order] = n
        return taken
    base = [c * goal // total for c in n]
    rest = goal - sum(a * b for a, b in zip(size, base))
    for i, a in enumerate(size):
        more = min(n[i] - base[i], rest // a)
        base[i] += more
        rest -= more * a
    nearest = lambda s: (abs(s * unit - over - room * unit), s)
    while rest or over:
        low, room = list(base), rest
        for i in reversed(range(len(size))):
            back = min(base[i], max(0, -(-(window - room) // size[i])))
            low[i] -= back
            room += back * size[i]
        # sums farther above the goal than the first pass is below it are no better
        reached = np.full(room + rest + 2, -1, dtype=np.int32)
        reached[0] = 0
        parts: list[tuple[int, int]] = [(-1, 0)]
        for i, a in enumerate(size):
            free, step = min(n[i] - low[i], (len(reached) - 1) // a), 1
            while free > 0 and (over or reached[room] < 0):
                take = min(step, free)
                free, step = free - take, step * 2
                parts.append((i, take))
                new = (reached[: -take * a] >= 0) & (reached[take * a :] < 0)
                reached[take * a :][new] = len(parts) - 1
        at = min((int(s) for s in np.flatnonzero(reached >= 0)), key=nearest)
        if nearest(at)[0] <= unit // 2 or not any(low):
            base = low
            while at:
                i, take = parts[reached[at]]
                base[i] += take
                at -= take * size[i]
            break
        window *= 2
    taken[order] = base
    return taken


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with the source as a key that is never null, and each row's rank and piece, which follow from its id."""
    rank = F.xxhash64(F.lit(seed), "doc_id")
    return docs.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-"))).withColumn("rank", rank).withColumn("piece", F.pmod(rank, F.lit(PIECES)))


def plan(docs: DataFrame, seed: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """(narrow rows of ``docs`` by key; what becomes of each source and size, and the last row taken once more).

    Columns of the second: cut_key, cut_size, source_size, target, times (copies of each), cut (piece, rank, doc_id of
    the last row of which one more is taken; null: none).  Rows are counted by (key, size, piece); only the piece that
    a cut falls into is ranked.  Rows that agree in id, source and size are taken alike.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.write(docs.select("doc_id", "source", word_count("text").alias("size")), "sizes")
    rows = keyed(sizes, seed)
    goals = scratch.write(targets(sizes, weights), "goals")
    pieces = scratch.write(rows.groupBy("key", "size", "piece").agg(F.count(F.lit(1)).alias("n")), "pieces")
    lengths = pieces.groupBy("key", "size").agg(F.sum("n").alias("n"))
    goals = goals.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("key"), "source_size", "target")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        times = min(int(target // whole), MOST) if whole else 0
        budget = round(target) - times * whole if times < MOST else 0
        group = group.sort_values("size", ignore_index=True)
        group["times"] = times
        group["chosen"] = fit(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), budget)
        return group[["key", "size", "source_size", "target", "times", "chosen"]]

    # one row for each length of a source: as many as its longest document has words at most
    chosen = lengths.join(goals, "key").groupBy("key").applyInPandas(choose, "key string, size long, source_size long, target double, times long, chosen long")
    chosen = scratch.write(chosen, "chosen")
    lower = Window.partitionBy("key", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.withColumn("lower", F.coalesce(F.sum("n").over(lower), F.lit(0))).join(chosen.select("key", "size", "chosen"), ["key", "size"])
    ends = scratch.write(ends.where("lower < chosen and chosen <= lower + n").select("key", "size", "piece", (F.col("chosen") - F.col("lower")).alias("last")), "ends")
    small = F.broadcast if ends.count() <= MOST_BROADCAST else lambda df: df
    at = F.row_number().over(Window.partitionBy("key", "size", "piece").orderBy("rank", "doc_id"))
    cuts = rows.join(small(ends), ["key", "size", "piece"]).withColumn("at", at).where("at = last")
    cuts = cuts.select("key", "size", F.struct("piece", "rank", "doc_id").alias("cut"))
    cuts = chosen.join(cuts, ["key", "size"], "left").select(F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), "source_size", "target", "times", "cut")
    return rows, scratch.write(cuts, "cuts")


def taken_of(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` (keyed, with size) and copies, source_size, target; rows move only if there are too many cuts for a broadcast."""
    if cuts.count() <= MOST_BROADCAST:
        cuts = F.broadcast(cuts)
    out = rows.join(cuts, (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size")))
    extra = F.coalesce(F.struct("piece", "rank", "doc_id") <= F.col("cut"), F.lit(False))
    return out.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("times") + extra.cast("long")).cast("long"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of ``docs``, repeated ones too: doc_id, source, size, source_size, target, taken, copies.

    Each source takes all of its documents floor(target / source size) times, and of the rest of its budget as many
    documents of each length as ``fit`` found, those with the smallest seeded hash of their ids first.  Rows that agree
    in id, source and size are taken alike, so a source may miss its target by such rows.  taken is copies times size.
    Null texts have size 0; documents of size 0 cost nothing and are taken once.  A null source is a source of its own,
    the last.  An empty table gives no rows.  Reruns choose the same documents.
    """
    out = taken_of(*plan(docs, seed, weights))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of the mix with all columns of ``docs``, each as often as :func:`mix` takes it."""
    _, cuts = plan(docs, seed, weights)
    texts = docs.select(F.struct(*docs.columns).alias("whole_row"), word_count("text").alias("size"), "doc_id", "source")
    out = taken_of(keyed(texts, seed), cuts).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("whole_row.*")
