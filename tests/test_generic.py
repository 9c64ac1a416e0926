from sparkwarden.plans.proofs import QUERIES


def test_unknown_meets_unknown_in_lists_of_orders(spark, tmp_path):
    ids = [1, 2, 997, 998, 1994, None]
    keys = [1, 2, 9973, 9974, 19946, 3_000_001 * 9973 + 2, None]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["null_safe_lookup"](spark, str(tmp_path))
    rest = lambda n, m: None if n is None or n % m == 0 else n % m
    pairs = [(i, k) for i in ids for k in keys if rest(i, 997) == rest(k, 9973)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, pairs))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline(orders") < plan.index("Join Inner") < plan.index("Aggregate [")
