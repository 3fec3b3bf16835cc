import pytest

from stratalog.plans import oracle, queries

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), oracle.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", ["greedy", "mst", "dfs", "msa", "tsp", "aco", "branches", "hilbert", "topological"])
def test_orderings_keep_all_groups(spark, sf_dir, name):
    t = queries.lake(spark, sf_dir)
    out = queries.QUERIES[f"order_{name}"](spark, sf_dir)
    assert out.select("room", "sg").exceptAll(t.history.groups.select("room", "sg")).isEmpty()
    assert out.count() == t.history.groups.count()


def test_decode_of_encode_under_any_ordering(spark, sf_dir):
    from pyspark.sql import functions as F

    from stratalog.operators import intervals

    t = queries.lake(spark, sf_dir)
    index = intervals.dense_index(t.history.groups.withColumn("ordering", F.xxhash64("sg")))
    runs = intervals.encode(t.state, index)
    back = intervals.decode(runs, index)
    members = t.state.select("room", "sg", "event").distinct()
    assert back.exceptAll(members).isEmpty() and members.exceptAll(back).isEmpty()


def test_comparison_is_at_least_the_number_of_events(spark, sf_dir):
    rows = {r["ordering"]: r["intervals"] for r in queries.QUERIES["order_comparison"](spark, sf_dir).collect()}
    events = queries.lake(spark, sf_dir).state.select("room", "event").distinct().count()
    assert min(rows.values()) >= events
    assert rows["tsp"] <= rows["hilbert"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
