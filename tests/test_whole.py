"""Whole jobs: queries over series read all rows of them."""

from tidebar.models import grouped
from tidebar.plans import regimes


def test_gibbs_reads_whole_series_and_runs_all_sweeps(spark, monkeypatch):
    rows, seen = spark.range(400).selectExpr("'a' AS series", "id AS row"), {}

    def draws(given, names, engine, **options):
        seen.update(options, rows=given.count(), engine=engine)
        return spark.createDataFrame([("a", [1.0, 2.0])], "series string, means array<double>")

    monkeypatch.setattr(regimes, "features", lambda spark, sf_dir: rows)
    monkeypatch.setattr(grouped, "posterior_draws", draws)
    assert regimes.gibbs_posterior(spark, "").count() == 2
    assert seen == {"rows": 400, "engine": "gibbs", "chains": 2, "rounds": 2000}
