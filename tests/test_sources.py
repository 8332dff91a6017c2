import json

import pytest
from pyspark.sql import functions as F

from markweave.schema import PREDICTION, POSITIONS, SIDE_SCORES
from markweave.sources import files, sinks
from markweave.streaming import resume


def write_raw(path, sep=",", bom=False, rows=2):
    names = ["Filename", "text_id_kaggle", "Text", "Rater_1", "Rater_2", *(f"{s}_{p}" for p in POSITIONS for s in SIDE_SCORES)]
    lines = [sep.join(names)] + [sep.join([f"e{k}", f"id{k}", f'"line one{sep} ""quoted""\nline two"', "rater_1", "rater_2", *["3" if k else "x"] * 16]) for k in range(rows)]
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + "\n".join(lines).encode())
    return path


@pytest.mark.parametrize(("sep", "bom"), [(",", False), (";", True), ("\t", False), ("|", True)])
def test_raw_csv(spark, tmp_path, sep, bom):
    p = write_raw(tmp_path / "a.csv", sep, bom, 3)
    assert files.detect_csv_format(spark, p) == ("utf-8-sig" if bom else "utf-8", sep)
    got = files.load_raw_scores(spark, p).orderBy("source_row_id").collect()
    assert [r.source_row_id for r in got] == [0, 1, 2] and [r.Filename for r in got] == ["e0", "e1", "e2"]
    assert got[0].Overall_1 is None and got[1].Overall_1 == 3 and "\nline two" in got[0].Text and '"quoted"' in got[0].Text


def test_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.resolve_input_path(spark, tmp_path / "none.csv")
    with pytest.raises(FileNotFoundError):
        files.resolve_input_path(spark, folder=tmp_path)
    a = write_raw(tmp_path / "a.csv")
    assert files.resolve_input_path(spark, folder=tmp_path) == str(a)
    write_raw(tmp_path / "b.csv")
    with pytest.raises(ValueError):
        files.resolve_input_path(spark, folder=tmp_path)
    (tmp_path / "c.csv").write_bytes(b"\xff\xfe\x00bad,\n" * 10)
    with pytest.raises(ValueError):
        files.detect_csv_format(spark, tmp_path / "c.csv")
    (tmp_path / "c.csv").write_text("Filename,Text\na,b\n")
    with pytest.raises(ValueError, match="Rater_1"):
        files.load_raw_scores(spark, tmp_path / "c.csv")


def test_sniffing(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a;b;c;d",e,f\n1;2;3;4;5;6\n')
    assert files.detect_csv_format(spark, tmp_path / "q.csv").delimiter == ","  # those within quotation marks don't count
    (tmp_path / "long.csv").write_bytes(("x,y\n" + "é" * files.SNIFFED).encode())  # the sniffed part ends within a letter
    assert files.detect_csv_format(spark, tmp_path / "long.csv") == ("utf-8", ",")
    (tmp_path / "empty.csv").write_bytes(b"")
    assert files.detect_csv_format(spark, tmp_path / "empty.csv") == ("utf-8", ",")
    assert files.find_csv_candidates(spark, tmp_path / "nowhere") == []


def test_row_numbers_over_partitions(spark):
    df = spark.range(0, 100, 1, 7).select(F.col("id").alias("x"))
    assert all(r.source_row_id == r.x for r in files.with_row_numbers(df).collect())


def test_records_round_trip(spark, tmp_path):
    assert files.read_jsonl(spark, tmp_path / "none", PREDICTION).count() == 0
    df = spark.createDataFrame([("1:1", None, ["a", "ü"])], "target_id string, predicted_overall int, history_ids array<string>")
    sinks.write_jsonl(df, tmp_path / "p")
    line = next(x for f in (tmp_path / "p").glob("*.json") for x in f.read_text().splitlines())
    assert json.loads(line) == {"target_id": "1:1", "predicted_overall": None, "history_ids": ["a", "ü"]}
    got = files.read_jsonl(spark, tmp_path / "p", PREDICTION).first()
    assert got.target_id == "1:1" and got.predicted_overall is None and got.history_ids == ["a", "ü"]


def test_tables_reports_and_configuration(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5)], "k string, v double")
    assert sinks.save_table(df, tmp_path / "t.csv").read_bytes().startswith(b"\xef\xbb\xbfk,v")
    assert json.loads(sinks.write_json(df, tmp_path / "s.json").read_text()) == {"k": "a", "v": 1.5}
    assert "| a | 1.500 |" in sinks.write_report("Report", [("One", df)], tmp_path / "r.md").read_text()
    sinks.write_csv(df, tmp_path / "csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 1
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs/c.yaml").write_text('{"seed": 7}')
    c = files.load_config(tmp_path / "configs/c.yaml")
    assert c["seed"] == 7 and files.project_path(c, "out") == tmp_path / "out" and files.project_path(c, "/x").as_posix() == "/x"
    (tmp_path / "m.json").write_text('{"target_ids": ["2:1", "1:1"]}')
    assert [r.target_id for r in files.read_target_list(spark, tmp_path / "m.json").orderBy("place").collect()] == ["2:1", "1:1"]
    assert set(sinks.experiment_metadata({"a": 1})) == {"experiment_id", "timestamp", "git_commit", "config"}


def test_resume_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, 3, "a"), (1, 5, "b"), (2, 3, "a")], "seed bigint, K int, target_id string")
    store = str(tmp_path / "store")
    assert resume.resume(df, store, df.schema).count() == 3
    resume.append_records(df.where("seed = 1"), store)
    assert [r.seed for r in resume.resume(df, store, df.schema).collect()] == [2]
    resume.append_records(df.where("seed = 2"), store)
    assert resume.resume(df, store, df.schema).count() == 0


def test_rater_counts_arrive_as_a_stream(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/rater_essay_wide.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = resume.rater_count_stream(spark, str(tmp_path / "in"), src.schema).writeStream.outputMode("complete").format("memory").queryName("rater_counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rater_counts").agg(F.sum("total_sample_count")).first()[0] == src.count()


def test_small_files_are_dealt_out_and_shuffled_tables_are_not(spark, tmp_path):
    from markweave.session import spread

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in spread(small).collect()) == list(range(100))
    shuffled = small.groupBy("id").count()
    assert spread(shuffled) is shuffled
    wide = spark.range(0, 100, 1, 2 * spark.sparkContext.defaultParallelism)
    assert spread(wide) is wide
