"""What the sweep over all variants reads again and again."""

from counterpoise.catalog import queries


def test_the_split_is_read_from_what_was_written_once(spark, sf, monkeypatch):
    plans, real = [], queries.rebalance_sweep

    def seen(df, *rest, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *rest, **options)

    monkeypatch.setattr(queries, "rebalance_sweep", seen)
    _, test = queries._variants(spark, sf)
    plans.append(test._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 1 + len(queries.METHODS) and not any("parquet" in p.lower() for p in plans)
