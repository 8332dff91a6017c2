import json

import pytest
from pyspark.sql import functions as F

from markweave.operators import experiments, prompts
from markweave.plans import runs
from test_sources import write_raw


def test_analysis(spark, sf, tmp_path):
    tables = runs.run_analysis(spark, f"{sf}/rater_essay_wide.parquet", str(tmp_path))
    assert len(tables) == 15 and len(list((tmp_path / "tables").glob("*.csv"))) >= 14
    report = (tmp_path / "report.md").read_text()
    assert "total_sample_count | 203" in report and "Strongest predictor" in report and "Of 203 samples" in report
    scalars = json.loads((tmp_path / "report_scalars.json").read_text())
    assert scalars["total_sample_count"] == "203" and scalars["lowest_overall_mean"] <= scalars["overall_mean"] <= scalars["highest_overall_mean"] and scalars["strongest_predictor"]
    import xml.etree.ElementTree as ET

    made = list((tmp_path / "figures").glob("*.svg"))
    assert len(made) == 12 and all(len(ET.parse(p).getroot()) > 5 for p in made)


def test_conversion(spark, tmp_path):
    wide, summary, counts = runs.run_conversion(spark, str(write_raw(tmp_path / "raw.csv", rows=4)), str(tmp_path / "out"))
    assert wide.count() == 8 and {r.metric: r.value for r in summary.collect()}["raw_row_count"] == 4
    assert spark.read.parquet(str(tmp_path / "out/rater_essay_wide.parquet")).count() == 8
    rows = spark.read.csv(str(tmp_path / "out/rater_essay_wide_csv"), header=True, multiLine=True, quote='"', escape='"').collect()
    assert [(r.source_row_id, r.rater_position) for r in rows] == [(str(k), str(p)) for k in range(4) for p in (1, 2)]
    assert [r.rater_id for r in counts.collect()] == ["rater_1", "rater_2"]


def stub():
    class Stub:
        def generate(self, prompts, parameters, n=1):
            return [[f'{{"predicted_overall": {1 + len(p) % 5}, "reasoning": "the essay is clear {k}x"}}' for k in range(n)] for p in prompts]

    return Stub


def test_phases(spark, sf, tmp_path):
    wide = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    out = runs.run_phases(wide, stub(), str(tmp_path), 10, 2, 7)
    assert out["predictions"].count() == 10 and out["candidates"].count() == 30
    assert out["predictions"].where("predicted_overall IS NULL").count() == 0
    m = json.loads((tmp_path / "prediction_metrics.json").read_text())
    assert m["n"] == 10 and 0 <= m["exact_accuracy"] <= 1
    s = json.loads((tmp_path / "verification_summary.json").read_text())
    assert s["candidate_total"] == 30 and s["verified_total"] == out["candidates"].where("verified").count()
    assert out["candidates"].where("verified AND reconstructed_overall <> gold_overall").count() == 0


def test_context_table(spark, sf):
    wide = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    t = runs.context_table(wide, (1, 3), 7, {"prediction": 384, "verification": 64})
    fit = experiments.context_fit(t, (512, 8192))
    rows = {(r.phase, r.k, r.max_model_len): r for r in fit.collect()}
    assert len(rows) == 8 and rows["prediction", 1, 8192].fit_rate >= rows["prediction", 3, 512].fit_rate and rows["prediction", 3, 512].prompt_tokens_mean > rows["prediction", 1, 512].prompt_tokens_mean
    df = spark.createDataFrame([("a b c",), ("",)], "prompt string")
    assert sorted(r.prompt_tokens for r in prompts.token_counts(df, lambda: lambda texts: [len(t.split()) for t in texts]).collect()) == [0, 3]
    counted = runs.context_table(wide.limit(0), (1,), 7, {"prediction": 1}, lambda x: prompts.token_counts(x, lambda: lambda texts: [len(t) for t in texts]))
    assert counted.agg(F.count("*")).first()[0] == 0


def test_phases_fit_the_context(spark, sf, tmp_path):
    wide = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    got = runs.run_phases(wide, stub(), str(tmp_path), 10, 5, 7, max_model_len=2000)["predictions"].select("prompt_token_estimate", "fitting_size", F.length("prompt").alias("n")).collect()
    assert len(got) == 10 and all(r.prompt_token_estimate == r.n // 3 + 1 <= 2000 - 384 for r in got) and min(r.fitting_size for r in got) < 5
    with pytest.raises(ValueError, match="exceed the context"):
        runs.run_phases(wide, stub(), str(tmp_path / "small"), 10, 4, 7, max_model_len=400)


def test_prompts_and_fits_of_all_targets(spark, sf):
    from markweave.operators import history
    from markweave.plans import experiments as E

    d = sf.replace("sf0.001", "sf0.01")
    want = history.eligible_targets(E.rows(spark, d), E.HISTORY).count()
    assert want > 200 and E._prompts(spark, d).count() == want and E._fit(spark, d).count() == want


def test_context_table_uses_every_reasoning(spark, sf):
    from markweave.plans import experiments as E

    texts = E.references(spark, sf).select("reference_reasoning").distinct().count()
    targets = E.latest_predictions(spark, sf).count()
    assert E._robin(spark, sf).select("reasoning").distinct().count() == min(texts, targets) > 3
    wide = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    total = lambda **x: runs.context_table(wide, (1,), 7, {"verification": 64}, **x).agg(F.sum("prompt_tokens"), F.count("*")).first()
    plain, full = total(), total(references=E.references(spark, sf))
    assert full[1] == plain[1] and full[0] > plain[0] + 5 * plain[1]


def test_commands(spark, sf, tmp_path, monkeypatch):
    raw = write_raw(tmp_path / "raw.csv", rows=3)
    monkeypatch.setattr(runs, "release_checkpoints", lambda spark: None)
    runs.main(["inference-input", "--input", str(raw), "--output", str(tmp_path / "a")])
    assert spark.read.csv(str(tmp_path / "a/inference_csv"), header=True).count() == 3
    runs.main(["context", "--input", f"{sf}/rater_essay_wide.parquet", "--output", str(tmp_path / "b"), "--sizes", "1", "--max-lengths", "512,4096"])
    assert (tmp_path / "b/context_fit.csv").read_text("utf-8-sig").count("\n") == 7
    with pytest.raises(SystemExit):
        runs.main(["pilot", "--input", "x", "--output", "y"])


def test_figures_of_empty_tables(tmp_path):
    import pandas as pd

    from markweave.sources import figures

    empty = pd.DataFrame({"r": [], "a": [], "b": []})
    assert figures.bars(empty, "r", ["a", "b"], "t", "l", tmp_path / "a.svg").exists()
    assert figures.heat_map(empty, "r", ["a"], "t", "l", 0, 1, tmp_path / "b.svg").exists()
    assert figures.bubbles(empty, "a", "b", "r", "t", 1, 5, tmp_path / "c.svg").exists()
    gaps = pd.DataFrame({"r": ["<x>", "y"], "a": [None, -1.5]})
    assert "&lt;x&gt;" in figures.bars(gaps, "r", ["a"], "t", "l", tmp_path / "d.svg").read_text()
