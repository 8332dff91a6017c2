import pytest

from markweave.operators import reshape
from markweave.schema import POSITIONS, SIDE_SCORES


def raw(spark):
    def row(k, text_id, **change):
        base = {"source_row_id": k, "Filename": "essay_a", "text_id_kaggle": text_id, "Text": f"essay {k}", "Rater_1": " rater_1 ", "Rater_2": "rater_2 "}
        base |= {f"{s}_{p}": str(2 + p) for p in POSITIONS for s in SIDE_SCORES}
        return base | change

    rows = [row(0, "x"), row(1, None, Overall_1="0", Cohesion_1="0", Grammar_2=None, Syntax_2="n/a")]
    return spark.createDataFrame(rows, ", ".join(f"{c} {'bigint' if c == 'source_row_id' else 'string'}" for c in rows[0]))


def test_positions_flags_and_statistics(spark):
    r = raw(spark)
    wide = {(x.source_row_id, x.rater_position): x for x in reshape.create_wide(r).collect()}
    assert len(wide) == 4
    assert wide[0, 1].Overall == 3 and wide[0, 2].Overall == 4 and wide[0, 1].rater_id == "rater_1" and wide[0, 2].rater_id == "rater_2"
    assert wide[1, 1].Overall == 0 and wide[1, 1].has_invalid_overall and wide[1, 1].has_invalid_trait and wide[1, 1].trait_min == 0
    assert wide[1, 2].Grammar is None and wide[1, 2].Syntax is None and wide[1, 2].has_invalid_trait and not wide[1, 2].has_invalid_overall
    assert wide[1, 2].trait_mean is None and wide[1, 2].trait_min is None and wide[1, 2].trait_max is None and wide[1, 2].trait_std is None
    assert wide[0, 1].trait_std == 0 and wide[0, 1].trait_mean == 3
    assert r.collect() == raw(spark).collect()


def test_violations_are_found(spark):
    r = raw(spark)
    wide = reshape.create_wide(r)
    assert {x.check: x.violations for x in reshape.conversion_violations(r, wide).collect()} == dict.fromkeys(("row_count", "unique_key", "positions", "filename_position_rows", "values"), 0)
    broken = wide.where("NOT (source_row_id = 0 AND rater_position = 1)")
    found = {x.check: x.violations for x in reshape.conversion_violations(r, broken).collect()}
    assert found["row_count"] == 1 and found["values"] == 1 and found["filename_position_rows"] == 1


def test_summary_and_long_forms(spark):
    r = raw(spark)
    wide = reshape.create_wide(r)
    s = {x.metric: x.value for x in reshape.conversion_summary(wide, r).collect()}
    assert s["raw_row_count"] == 2 and s["wide_row_count"] == 4 and s["duplicate_filename_position_rows"] == 4 and s["duplicate_source_row_position_rows"] == 0
    long = reshape.trait_long(r)
    assert long.count() == 2 * 14
    one = long.where("trait = 'Overall' AND rater_position = 1 AND text_id_kaggle = 'x'").first()
    assert one.score == 3 and one.partner_score == 4 and one.partner_rater_id == "rater_2"
    assert reshape.essay_long(r).count() == 4
    assert {(x.rater_id, x.sample_count, x.position_1_count, x.position_2_count) for x in reshape.position_counts(wide).collect()} == {("rater_1", 2, 2, 0), ("rater_2", 2, 0, 2)}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="Rater_2"):
        reshape.create_wide(raw(spark).drop("Rater_2"))
