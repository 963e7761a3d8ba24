import __spark_entry__ as E


def test_entry_runs_on_smallest_scale(spark):
    df = E.entry(spark)
    assert df.columns == ["o_orderpriority", "total_amount", "n_orders", "avg_amount"]
    assert df.count() == 5


def test_every_query_is_registered_with_oracle_or_reason():
    from sluice.plans import catalog

    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 80
    assert set(sql) <= set(qs)
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_sample_of_queries_run_at_smallest_scale(spark):
    qs = E.queries()
    for name in ("filter_complement", "map_date_yy_mm_dd", "validate_unique", "agg_multi", "profile_columns",
                 "records_drill"):
        assert qs[name](spark, "/root/testdata/sf0.001").count() >= 0


def test_cluster_settings_scale_with_input():
    from sluice.session import cluster_settings

    small = cluster_settings(10 << 30)
    big = cluster_settings(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == "200000"
    assert int(cluster_settings(10 << 40)["spark.sql.shuffle.partitions"]) == 40960
