"""The perturbed forecast writes each row once, however many blocks there are."""
import datetime
import random

from netreach.operators import contribution, forecast


def test_blocks_are_written_once(spark, monkeypatch):
    """Rows were copied to every pair of blocks they are met in, which filled the disks."""
    r = random.Random(9)
    names = ["C_a", "C_b"] + [f"W_{i}" for i in range(10)]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(weeks=k) for k in range(9)]
    series = spark.createDataFrame([(d, w, r.uniform(1, 9)) for d in days for w in names], "t date, node string, x double")
    pairs = sorted({(d, *r.sample(names, 2)) for d in days for _ in range(10)})
    edges = spark.createDataFrame([(*p, r.uniform(0.1, 2)) for p in pairs], "t date, src string, dst string, w double")
    table = forecast.training_table(series, edges, max_gap_weeks=3)
    model = forecast.fit(table, forecast.columns(4))
    written, stage = [], contribution.stage
    monkeypatch.setattr(contribution, "stage", lambda df: written.append(stage(df)) or written[-1])
    risk = contribution.model_risk(edges, forecast.scaled_series(series)[0], forecast.predict(model, table), model.coefficients, self_dampen=0.5, block=3)
    assert risk.count() > len(names)
    assert max(df.count() for df in written) <= len(pairs)
