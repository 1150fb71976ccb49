"""Prepare, run twice, report; refusals of configs."""

import json

import pytest

from quillon import cli, runner
from quillon.plans import relations as R

CONFIG = {"train_start": R.TRAIN_START, "validation_start": "1996-01-01T00:00:00Z", "test_start": R.TEST_START, "test_end": R.TEST_END, "update_interval_ms": R.INTERVAL, "feedback_delay_ms": R.DELAY,
          "evaluation_feedback": "frozen", "seed": 42, "model": "popularity", "interaction_features": True, "relative_temporal_features": True}


def test_prepare_run_report(spark, sf, tmp_path, capsys):
    prepared, config = str(tmp_path / "samples"), tmp_path / "c.json"
    config.write_text(json.dumps(CONFIG))
    assert cli.main(["prepare", sf, prepared]) == 0
    for name, model in (("a", "popularity"), ("b", "popularity"), ("c", "lr")):
        assert cli.main(["run", prepared, str(config), str(tmp_path / name), "--model", model]) == 0
    a, b, c = (json.loads((tmp_path / n / "metrics.json").read_text()) for n in "abc")
    assert a == b and 0 < c["test"]["impression"]["auc"] < 1
    assert cli.main(["report", str(tmp_path / "r.csv"), str(tmp_path / "a"), str(tmp_path / "c")]) == 0
    assert len((tmp_path / "r.csv").read_text().splitlines()) == 3
    with pytest.raises(FileExistsError):
        runner.run(spark, prepared, str(tmp_path / "a"), CONFIG)


def test_refusals(spark, sf):
    with pytest.raises(ValueError):
        runner.frozen_at({"evaluation_feedback": "other"})
    with pytest.raises(ValueError):
        runner.boundary("2020-01-01T00:00:00")
    with pytest.raises(ValueError):
        runner.split_samples(R.samples(spark, sf), {"train_start": 0, "validation_start": 1, "test_start": 2, "test_end": 3})


def test_retrieval_run(spark, sf):
    out = runner.run_retrieval(spark, R.sequence(spark, sf), {"k": 10, "max_queries_per_split": 50})
    assert set(out) == {"validation", "test"} and out["test"]["hot"]["n_queries"] <= 50 and 0 <= out["test"]["i2i_hot"]["recall"] <= 1
