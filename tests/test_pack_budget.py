from test_engine import Facts

from spanloom.operators.context import pack
from spanloom.queries import tables


def test_the_query_packs_into_the_default_budget(spark, tmp_path):
    facts = Facts(spark)
    hub = facts.fn("hub")
    for i in range(30):
        facts.edge(facts.fn(f"caller_number_{i}"), hub)
    for name, table in facts.engine().tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    callers = tables.tier_budget_pack(spark, str(tmp_path)).filter("tier = 'callers'").first()
    assert callers.cost > 60 and callers.included


def test_a_small_budget_leaves_out_what_does_not_fit(spark, rows):
    seeds = spark.createDataFrame([(1,)], "seed long")
    items = spark.createDataFrame([(1, "callers", "x" * 300), (1, "errors", "E")], "seed long, tier string, item string")
    packed = pack(items, seeds, 60).filter("n_items > 0")
    assert rows(packed, "tier", "included") == [("callers", False), ("errors", True)]
