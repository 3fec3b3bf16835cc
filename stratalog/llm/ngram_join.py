"""Near-duplicate join of texts by the Jaccard similarity of their word shingles: a grouped prefix join."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, Scratch, free_name, in_batches, trimmed, without
from .components import components
from .shingles import digest, mixed, packed, sets_of, sketch, unlike, unpacked

NEED, OF = 75, 100  # sets link when OF * shared >= NEED * union
SMALL_LIST = 24  # sets up to which a list's open pairs are joined; longer lists are compared in blocks
BLOCK = 1024
HINTS = 16
CELLS = 1 << 21  # of each of the two rows of the sketch of shingle counts; its levels take a byte a cell
UNIT = 16  # counts of a task below it are sent as so many, with a chance in proportion
LEADERS = 4  # of each list and round; the first round takes one


def prefix_length(n: int) -> int:
    """Sets that link share a shingle among the first so many of each, in any order common to all sets."""
    return n - -(-NEED * n // OF) + 1


def may_link(n: Column, at: Column, other_n: Column, other_at: Column) -> Column:
    """Whether sets of these sizes whose first common shingle has these places can link: what comes behind is all they can share."""
    return (OF + NEED) * F.least(n - at, other_n - other_at) >= NEED * (n + other_n)


def cells_of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of shingles in the two rows of the count sketch, numbered through."""
    x = shingles.astype(np.uint64)
    return (x % np.uint64(CELLS)).astype(np.int64), CELLS + (x // np.uint64(CELLS) % np.uint64(CELLS)).astype(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """One pass over the texts.  Rows with a null cell: doc_id, gid (identity of its shingle set), n (its size), sketch,
    and the row's third column as mark.

    Rows with a cell: how many (n) of the task's shingles fall into it.  All shingles count; to keep the rows few, counts
    below UNIT are rounded to 0 or UNIT, by a hash and without bias.
    """

    def task(batches):
        from pyspark import TaskContext

        counts, pool, held = np.zeros(2 * CELLS, dtype=np.uint32), [], 0

        def pour():
            for cells in cells_of(np.concatenate(pool)):
                np.add(counts, np.bincount(cells, minlength=len(counts)), out=counts, casting="unsafe")

        for batch in batches:
            gids, sizes, sketches = [], [], []
            for s in sets_of(batch.column(1)):
                gids.append(digest(s) if len(s) else None)
                sizes.append(len(s))
                sketches.append(sketch(s) if len(s) else None)
                pool.append(s)
                held += len(s)
                if held > 1 << 21:
                    pour()
                    pool, held = [], 0
            columns = [batch.column(0), pa.array(gids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.nulls(len(gids), pa.int32()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "gid", "n", "sketch", "cell", "mark"])
        if held:
            pour()
        full = np.flatnonzero(counts)
        draw = mixed(full.astype(np.uint64) + np.uint64(TaskContext.get().partitionId() << 32)) % np.uint64(UNIT)
        full = full[counts[full] > draw]
        for at in range(0, len(full), 100_000):
            cell = full[at : at + 100_000]
            none = [pa.nulls(len(cell), t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())]
            columns = [none[0], none[1], pa.array(np.maximum(counts[cell], UNIT).astype(np.int32)), none[2], pa.array(cell.astype(np.int32)), none[3]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "gid", "n", "sketch", "cell", "mark"])

    return in_batches(docs).mapInArrow(trimmed(task), "doc_id long, gid long, n int, sketch binary, cell int, mark binary")


def count_levels(counted: DataFrame) -> np.ndarray:
    """One byte for each cell of the sketch, of fixed size: four times the binary logarithm of its count."""

    def task(batches):
        for batch in batches:
            n = batch.column(1).to_numpy().astype(np.float64)
            level = np.minimum(255, 4 * np.log2(n)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"cells": [batch.column(0).to_numpy().astype("<i4").tobytes()], "levels": [level.tobytes()]})

    out = np.zeros(2 * CELLS, dtype=np.uint8)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).mapInArrow(task, "cells binary, levels binary").collect():
        out[np.frombuffer(r["cells"], "<i4")] = np.frombuffer(r["levels"], np.uint8)
    return out


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """(token, fit, owner): the prefix of each group of texts, and each group's members.

    Shingles are ordered by their level in the count sketch, the rarest first, then by hash; any fixed order is right,
    this one keeps common shingles out of the prefixes.  A group holds all sets with one prefix and one size; its owner
    is a digest of them.  fit is the size and, below it, the shingle's place in the prefix.  A member row has token
    -(gid + 1).
    """

    def task(batches):
        recent = OrderedDict()
        names = ["token", "fit", "owner"]
        for batch in batches:
            tokens, fits, owners, held = [], [], [], 0
            for s in sets_of(batch.column(0)):
                if not len(s):
                    continue
                gid = digest(s)
                if gid in recent:  # a copy of a recent text
                    continue
                recent[gid] = None
                if len(recent) > 20_000:
                    recent.popitem(last=False)
                one, two = cells_of(s)
                head = s[np.argsort(np.minimum(levels[one], levels[two]), kind="stable")[: prefix_length(len(s))]].astype(np.int64)
                owner = digest(np.append(np.sort(head), len(s)))
                tokens += [head, [-(gid + 1)]]
                fits.append((len(s) << 32) + np.append(np.arange(len(head)), 0))
                owners.append(np.full(len(head) + 1, owner, dtype=np.int64))
                held += len(head)
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, fits, owners)], names=names)
                    tokens, fits, owners, held = [], [], [], 0
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, fits, owners)], names=names)

    return in_batches(docs).select("text").mapInArrow(trimmed(task), "token long, fit long, owner long")


def filtered_groups(entries: DataFrame) -> DataFrame:
    """Of rows sorted by (token, fit, owner) those whose group can pair by size with another group of the token, and all
    member rows, each once.

    Sizes rise within a token, so a group that fits neither its neighbour before nor the one behind fits none.
    """

    def task(batches):
        held, before = np.zeros((3, 0), dtype=np.int64), None  # the last row, whose successor is not known yet; whether it fits the one ahead

        def pairs(rows):
            size = rows[1] >> 32
            return (rows[0, 1:] == rows[0, :-1]) & (OF * size[:-1] >= NEED * size[1:])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            new = np.ones(rows.shape[1], dtype=bool)
            new[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
            rows = rows[:, new]
            like = pairs(rows)
            keep = rows[0] < 0
            keep[1:] |= like
            keep[:-1] |= like
            keep[0] |= bool(before)
            out = rows[:, :-1][:, keep[:-1]]
            if rows.shape[1] > 1:
                before = like[-1]
            held = rows[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["token", "fit", "owner"])
        if held.shape[1] and (held[0, 0] < 0 or before):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["token", "fit", "owner"])

    return entries.mapInArrow(trimmed(task), "token long, fit long, owner long")


def candidate_sets(docs: DataFrame, wanted: DataFrame, many: bool) -> DataFrame:
    """(gid, n, hashes) of the texts with one of the ``wanted`` ids (first_id), read again from the texts."""
    wanted = wanted if many else F.broadcast(wanted)
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("first_id")), "left_semi").select("text")

    def task(batches):
        for batch in batches:
            rows = [(digest(s), len(s), packed(s)) for s in sets_of(batch.column(0)) if len(s)]
            if rows:
                gid, n, raw = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(gid, pa.int64()), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], names=["gid", "n", "hashes"])

    return in_batches(texts).mapInArrow(trimmed(task), "gid long, n int, hashes binary")


def with_sides(pairs: DataFrame, rows: int, table: DataFrame, column: str) -> DataFrame:
    """(u, v, u_x, v_x): both sides' values of ``column`` (gid, x) for each of the ``rows`` distinct, written ``pairs``.

    v is the leader, of which there are few: the other side's value travels with the pair.
    """
    small = F.broadcast if rows <= MOST_BROADCAST else lambda df: df
    one = table.select(F.col("gid").alias("u"), F.col(column).alias("u_x"))
    two = table.select(F.col("gid").alias("v"), F.col(column).alias("v_x")).join(small(pairs.select("v").distinct()), "v", "left_semi")
    return one.join(small(pairs), "u").hint("merge").join(two.hint("merge"), "v").select("u", "v", "u_x", "v_x")


def close(pairs: DataFrame) -> DataFrame:
    """The (u, v) whose sketches allow a similarity of NEED / OF; rows (u, v, u_x, v_x, total) with both sizes' sum."""

    def task(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            total = batch.column(4).to_pylist()
            # shared >= need * union means unlike * (of + need) <= (of - need) * (sum of sizes)
            keep = [(OF + NEED) * unlike(x, y) <= (OF - NEED) * t for x, y, t in zip(a, b, total)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(trimmed(task), "u long, v long")


def folded(rows: list[bytes], size: int) -> np.ndarray:
    out = []
    for raw in rows:
        x = np.frombuffer(raw, np.uint8)
        while len(x) > size:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out.append(x)
    return np.stack(out).view(np.uint64)


def close_in_block(key, gid, label, n, sketches, hints, left, right):
    """(u, v) of the pairs of one block that are of different labels and pass sizes and sketches.

    A pair whose hints, the least keys of each side's long lists, share one comes from the list of the least shared.
    """
    size = np.array([len(x) for x in sketches])
    for a in np.unique(size[left]):
        for b in np.unique(size[right]):
            i, j = left[size[left] == a], right[size[right] == b]
            x, y = (folded([sketches[k] for k in at], int(min(a, b))) for at in (i, j))
            for row, bits in zip(i.tolist(), x):
                low, high = np.minimum(n[row], n[j]), np.maximum(n[row], n[j])
                maybe = np.flatnonzero((label[j] != label[row]) & (gid[j] < gid[row]) & (OF * low >= NEED * high))
                if len(maybe):
                    apart = np.bitwise_count(y[maybe] ^ bits).sum(1, dtype=np.int64)
                    for k in j[maybe[(OF + NEED) * apart <= (OF - NEED) * (n[row] + n[j[maybe]])]].tolist():
                        if min(hints[row] & hints[k], default=key) == key:
                            yield int(gid[row]), int(gid[k])


def long_lists(open_: DataFrame, sizes: DataFrame, firsts: DataFrame) -> DataFrame:
    """(u, v) of the close pairs of different labels in lists over SMALL_LIST, compared in blocks of about BLOCK sets.

    A list of m sets is dealt into m / BLOCK parts, and each pair of parts is compared by itself, on any worker.
    """
    parts = (1 + F.floor(F.col("m") / BLOCK)).cast("int")
    rows = open_.select("key", "gid", "label", "n").join(sizes.where(F.col("m") > SMALL_LIST).select("key", parts.alias("parts")), "key")
    hints = rows.groupBy("gid").agg(F.slice(F.sort_array(F.collect_set("key")), 1, HINTS).alias("hints"))
    rows = rows.join(hints.join(firsts.select("gid", "sketch"), "gid"), "gid").withColumn("part", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "gid", "label", F.col("n").cast("long").alias("n"), "sketch", "hints")
    count = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(count, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def block(table: pa.Table) -> pa.RecordBatch:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        part, gid, label, n = (table[c].to_numpy() for c in ("part", "gid", "label", "n"))
        one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
        sides = [(one, two)] if low == high else [(one, two), (two, one)]
        key, sketches, hints = table["key"][0].as_py(), table["sketch"].to_pylist(), [set(h) for h in table["hints"].to_pylist()]
        out = [p for a, b in sides for p in close_in_block(key, gid, label, n, sketches, hints, a, b)] if len(one) and len(two) else []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(2)], names=["u", "v"])

    def task(batches):
        held = None  # rows of the block that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            ids = np.stack([table[c].to_numpy() for c in ("key", "low", "high")])
            cut = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist()]
            for a, b in zip(cut, cut[1:]):
                yield block(table.slice(a, b - a))
            held = table.slice(cut[-1])
        if held is not None and held.num_rows:
            yield block(held)

    return rows.mapInArrow(trimmed(task), "u long, v long")


def linked(pairs: DataFrame) -> DataFrame:
    """The (u, v) whose whole sets link; rows (u, v, u_x, v_x)."""

    def task(batches):
        last = (None, None)
        for batch in batches:
            us, vs = [], []
            for u, v, a, b in zip(*(batch.column(i) for i in range(4))):
                v = v.as_py()
                if last[0] != v:
                    last = (v, unpacked(b.as_py()))
                x, y = unpacked(a.as_py()), last[1]
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                if OF * both >= NEED * (len(x) + len(y) - both):
                    us.append(u.as_py())
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return pairs.mapInArrow(trimmed(task), "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, scratch: Scratch, tag: str, rows: int) -> DataFrame:
    """The (u, v) of at most ``rows`` distinct ``pairs`` whose whole sets link; written.

    Sketches, which can only overrate a pair, leave few pairs.  Only their texts are read again for whole sets.
    """
    pairs = scratch.write(pairs, f"{tag}-pairs", rows)
    rows = pairs.count()
    sided = with_sides(pairs, rows, firsts.withColumn("x", F.struct("n", "sketch")), "x")
    sided = sided.select("u", "v", F.col("u_x.sketch").alias("u_x"), F.col("v_x.sketch").alias("v_x"), (F.col("u_x.n") + F.col("v_x.n")).cast("long").alias("total"))
    pairs = scratch.write(close(sided.coalesce(1 + rows // 20_000)), f"{tag}-close")
    rows = pairs.count()
    scratch.drop(f"{tag}-pairs")
    gids = pairs.select(F.col("u").alias("gid")).unionByName(pairs.select(F.col("v").alias("gid"))).distinct()
    sets = scratch.write(candidate_sets(docs, gids.join(firsts, "gid").select("first_id"), 2 * rows > MOST_BROADCAST), f"{tag}-sets")
    found = sets.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gid").alias("gids")).first()
    if found["n"] > found["gids"]:  # rows repeated with one id and text
        sets = scratch.write(sets.dropDuplicates(["gid"]), f"{tag}-sets-once")
    out = scratch.write(linked(with_sides(pairs, rows, sets, "hashes").coalesce(1 + rows // 2000)), f"{tag}-links")
    scratch.drop(f"{tag}-sets", f"{tag}-sets-once", f"{tag}-close")
    scratch.release()
    return out


def link(docs: DataFrame, rounds: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id; repeated rows return as often as they occur.

    Shingles are five neighbouring words, A to Z in lower case; a text of fewer words is one shingle.  Texts link when
    their sets' Jaccard similarity is 0.75 or more; component_id is the smallest doc_id that links reach.  Null texts and
    texts without words have no shingle and link with nothing, not even with each other: their own doc_id is their
    component.  A null doc_id links like any other but is not the smallest unless no other is there.

    The join is exact.  Equal sets collapse first; sets with equal prefix and size collapse into groups.  Groups that share
    a prefix shingle are paired if their sizes, and the shingle's places in their prefixes, allow a link; only then are
    they expanded to their sets, and these verified.  The first round pairs each group with one leader for each of its
    shingles.  Lists whose sets are not in one component after that go on: the long ones in further rounds of leaders, up to
    ``rounds`` in all, then all pairs of different components are verified, in short lists by a join, in long ones in blocks.
    """
    scratch = Scratch(docs.sparkSession, "ngram-join")
    return assigned(*labelled(docs, F.lit(None), scratch, rounds), scratch)


def labelled(docs: DataFrame, mark: Column, scratch: Scratch, rounds: int = 3) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """What :func:`link` finds: rows (doc_id, gid, n, mark) of ``docs``, its distinct sets, the labels of those that link, how many sets."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), mark.cast("binary").alias("mark"))
    seen = scratch.write(survey(docs), "survey")
    docs = docs.drop("mark")
    ids = seen.where("cell is null").select("doc_id", "gid", "n", "mark")
    entries = prefixes(docs, count_levels(seen.where("cell is not null").select("cell", "n")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(parts, "token").sortWithinPartitions("token", "fit", "owner")
    entries = scratch.write(filtered_groups(entries), "groups")
    scratch.release()
    firsts = seen.where("gid is not null").groupBy("gid").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    firsts = scratch.write(firsts, "firsts")
    texts = firsts.count()
    rows = entries.count()
    # every group and set is there once: rows of one token are in one partition
    members = entries.where("token < 0").select((-F.col("token") - 1).alias("gid"), "owner", F.shiftright("fit", 32).alias("n"))
    several = members.groupBy("owner", "n").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    keys = entries.where("token >= 0").select(F.col("token").alias("key"), "owner", F.shiftright("fit", 32).alias("n"), F.col("fit").bitwiseAND((1 << 32) - 1).alias("at"))
    keys = keys.unionByName(several.select(F.col("owner").alias("key"), "owner", "n", F.lit(0).cast("long").alias("at")))
    # the first round, group by group: those that pass the filter meet one set of their list's leader
    first = F.min(F.struct(F.xxhash64("owner").alias("h"), F.col("owner").alias("leader"), F.col("n").alias("l_n"), F.col("at").alias("l_at"))).alias("l")
    leaders = scratch.write(keys.groupBy("key").agg(first).select("key", "l.leader", "l.l_n", "l.l_at"), "leaders-0", rows)
    pairs = keys.join(leaders, "key").where(((F.col("owner") != F.col("leader")) | (F.col("owner") == F.col("key"))) & may_link(F.col("n"), F.col("at"), F.col("l_n"), F.col("l_at")))
    pairs = scratch.write(pairs.select("owner", "leader").distinct(), "group-pairs", rows)
    chosen = members.groupBy("owner").agg(F.min(F.struct(F.xxhash64("gid").alias("h"), "gid")).alias("s"))
    pairs = pairs.join(members.select("owner", F.col("gid").alias("u")), "owner").join(chosen.select(F.col("owner").alias("leader"), F.col("s.gid").alias("v")), "leader")
    edges = verified(pairs.where("u <> v").select("u", "v").distinct(), docs, firsts, scratch, "round-0", rows)
    labels = components(edges, scratch, "round-0", rows)
    # lists whose sets are not all in one component yet, expanded to these
    marked = scratch.write(labelled_sets(members, labels), "labelled-sets", texts)
    spread = marked.groupBy("owner").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    open_keys = keys.join(spread, "owner").groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("key")
    open_keys = scratch.write(open_keys, "open-keys", rows)
    lists = keys.join(open_keys, "key").select("key", "owner", "at").join(marked, "owner").select("key", "gid", "n", "at", "label")
    now = lists = scratch.write(lists, "lists", rows)
    rows = lists.count()
    scratch.drop("groups", "group-pairs")
    for at in range(1, rounds + 1):
        if at > 1:
            now = scratch.write(labelled_sets(lists.drop("label"), labels), f"labelled-{at}", rows)
        sizes = now.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("m")).where("a <> b").select("key", "m")
        sizes = scratch.write(sizes, f"keys-{at}", rows)
        long_ = sizes.where(F.col("m") > SMALL_LIST).count()
        if at == rounds or not long_:
            break
        open_ = now.join(sizes.where(F.col("m") > SMALL_LIST).select("key"), "key")
        fields = F.col("gid").alias("gid"), F.col("label").alias("label"), F.col("n").alias("n"), F.col("at").alias("at")
        best = lambda i: F.min(F.struct(F.xxhash64("gid", F.lit(LEADERS * at + i)).alias("h"), *fields))  # noqa: B023, E731
        leaders = open_.groupBy("key").agg(*(best(i).alias(f"l{i}") for i in range(LEADERS)))
        leaders = leaders.select("key", F.explode(F.array_distinct(F.array(*(F.struct(*(F.col(f"l{i}.{c}") for c in ("gid", "label", "n", "at"))) for i in range(LEADERS))))).alias("l"))
        leaders = leaders.select("key", F.col("l.gid").alias("v"), F.col("l.label").alias("v_label"), F.col("l.n").alias("v_n"), F.col("l.at").alias("v_at"))
        leaders = scratch.write(leaders, f"leaders-{at}", LEADERS * rows)
        pairs = open_.join(leaders, "key").where((F.col("label") != F.col("v_label")) & may_link(F.col("n"), F.col("at"), F.col("v_n"), F.col("v_at")))
        new = verified(pairs.select(F.col("gid").alias("u"), "v").distinct(), docs, firsts, scratch, f"round-{at}", LEADERS * rows)
        edges = edges.unionByName(new)
        labels = components(edges, scratch, f"round-{at}", edges.count())
    if not sizes.isEmpty():
        short = now.join(sizes.where(F.col("m") <= SMALL_LIST).select("key"), "key")
        a, b = (short.toDF(*(f"{side}_{c}" for c in short.columns)) for side in "ab")
        pairs = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_label") < F.col("b_label")) & may_link(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at")))
        pairs = pairs.select(F.greatest("a_gid", "b_gid").alias("u"), F.least("a_gid", "b_gid").alias("v"))
        if long_:
            pairs = pairs.unionByName(long_lists(now, sizes, firsts))
        edges = edges.unionByName(verified(pairs.distinct(), docs, firsts, scratch, "last", SMALL_LIST * rows))
        labels = components(edges, scratch, "last", edges.count())
    return ids, firsts, labels, texts


def labelled_sets(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with gid) and the label of each set, its own gid if it has none."""
    return rows.join(labels.select(F.col("node").alias("gid"), "label"), "gid", "left").withColumn("label", F.coalesce("label", "gid"))


def assigned(ids: DataFrame, firsts: DataFrame, labels: DataFrame, texts: int, scratch: Scratch) -> DataFrame:
    known = firsts.join(labels.select(F.col("node").alias("gid"), "label"), "gid", "left")
    known = scratch.write(known.select("gid", F.coalesce("label", "gid").alias("label"), "first_id"), "known", texts)
    least = known.groupBy("label").agg(F.min("first_id").alias("least_id"))
    known = scratch.write(known.join(least, "label").select("gid", "least_id"), "components", texts)
    out = ids.join(known, "gid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, and all without a shingle; all columns.

    The smallest doc_id stays, a null one only if all are null, and of one doc_id's texts that with the smallest digest.
    Rows are told apart by doc_id and text, so other texts of a doc_id that goes, null or not, stay.  Of rows repeated
    with the same id and text, one stays.
    """
    scratch = Scratch(docs.sparkSession, "ngram-keep")
    digest_ = F.unhex(F.sha2(F.col("text").cast("string"), 256))
    ids, firsts, labels, texts = labelled(docs, digest_, scratch)
    rows = ids.where("gid is not null").groupBy("doc_id", "gid", "mark").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.write(rows, "rows")
    known = firsts.select("gid").join(labels.select(F.col("node").alias("gid"), "label"), "gid", "left")
    known = scratch.write(known.select("gid", F.coalesce("label", "gid").alias("label")), "known", texts)
    rows = scratch.write(rows.join(known, "gid").select("label", "doc_id", "mark", "copies"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    best = scratch.write(rows.groupBy("label").agg(first), "best", texts)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    # repeated rows leave with the others, and one of each comes back
    found = rows.join(best, "label").withColumn("kept", kept).where("not kept or copies > 1")
    mark, other_id, other = free_name(docs, "text_mark"), free_name(docs, "again_id"), free_name(docs, "again_mark")
    found = scratch.write(found.select("doc_id", F.col("mark").alias(mark), "kept"), "gone")
    marked = docs.withColumn(mark, digest_)
    out = without(marked, found.select("doc_id", mark))
    again = found.where("kept").select(F.col("doc_id").alias(other_id), F.col(mark).alias(other))
    if not again.isEmpty():
        small = F.broadcast(again) if again.count() <= MOST_BROADCAST else again
        on = marked["doc_id"].eqNullSafe(F.col(other_id)) & (marked[mark] == F.col(other))
        out = out.unionByName(marked.join(small, on, "left_semi").dropDuplicates(["doc_id", mark]))
    return out.select(*docs.columns)
