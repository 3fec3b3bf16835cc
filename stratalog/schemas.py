"""Table schemas and parameters of the engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _table(*fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


L, I, S, INTS = T.LongType(), T.IntegerType(), T.StringType(), T.ArrayType(T.IntegerType())

STATE_GROUPS = _table(("id", L, False), ("room_id", S, False), ("event_id", S, False))
STATE_GROUP_EDGES = _table(("state_group", L, False), ("prev_state_group", L, False))
STATE_GROUPS_STATE = _table(*(("state_group", L, True),), *((c, S, True) for c in ("room_id", "type", "state_key", "event_id")))
STATE = _table(("start_index", L, False), ("end_index", L, True), ("start_sg_id", L, False), ("end_sg_id", L, True), *((c, S, False) for c in ("event_id", "room_id", "type", "state_key")))
MINHASHES = _table(("sg_id", L, False), ("room_id", S, False), ("minhash", INTS, False), ("lsh_bands", INTS, False), ("add_count", I, False), ("gone_count", I, False), ("ordering", L, True), ("branch", L, True))


@dataclass(frozen=True)
class Params:
    permutations: int = 128
    bands: int = 16
    jump: int = 10  # churn above which a section starts
    branch_jump: int = 5  # churn above which a branch may start
    min_bands: int = 1  # shared bands of a branch point
    branch_bands: int = 8
    hotspot: int = 10  # intervals starting at one index
    seed: int = 42


PARAMS = Params()
