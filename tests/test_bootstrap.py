"""The query draws as many resamples as the operator does by default."""

from factmill import queries
from factmill.operators import metrics


def test_production_resamples(spark, tiny, monkeypatch):
    drawn = []
    monkeypatch.setattr(metrics, "bootstrap_interval", lambda values, column, resamples=10_000, **_: drawn.append(resamples))
    queries.QUERIES["bootstrap_ci"](spark, tiny)
    assert drawn == [10_000]
