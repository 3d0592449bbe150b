"""Files in and out."""

import fixtures
import pytest

from tallyframe.operators import ml_training
from tallyframe.plans.analysis import analyse
from tallyframe.sources import sinks, tables


def test_csv_null_tokens_and_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name,price,note\n"a ""b"", c",1,NA\nx,2.5,null\ny,NaN,missing\n')
    df = tables.read_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [('a "b", c', "1", None), ("x", "2.5", None), ("y", None, "missing")]
    typed = tables.typed_numbers(df)
    assert dict(typed.dtypes) == {"name": "string", "price": "double", "note": "string"}
    with pytest.raises(ValueError, match="not found: z"):
        tables.require_columns(df, ["name", "z"])


def test_csv_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('name,price\n"two\nlines",1\nx,2\n')
    with pytest.raises(ValueError, match="multi_line"):
        tables.read_csv(spark, str(path))
    df = tables.read_csv(spark, str(path), multi_line=True)
    assert [tuple(r) for r in df.collect()] == [("two\nlines", "1"), ("x", "2")]


def test_csv_round_trip(spark, tmp_path):
    df = fixtures.performance(spark)
    sinks.write_csv(df, str(tmp_path / "out"))
    back = tables.typed_numbers(tables.read_csv(spark, str(tmp_path / "out"), df.columns))
    assert back.count() == 40 and back.agg({"Productivity_Score": "sum"}).first()[0] == 12 * 52 + 18 * 81 + 10 * 68


def test_analysis_as_json(spark, tmp_path):
    found = analyse(fixtures.jobs(spark))
    sinks.write_tables(found.tables, str(tmp_path / "analysis"))
    schema = found.tables["numeric"].schema
    back = tables.read_json(spark, str(tmp_path / "analysis" / "numeric"), schema)
    assert back.orderBy("column").collect() == found.tables["numeric"].orderBy("column").collect()


@pytest.mark.parametrize("target", ["Performance_Category"])
def test_model_round_trip(spark, tmp_path, target):
    df = fixtures.performance(spark).drop("Student_ID")
    result = ml_training.train(df, target, "fast")
    assert result.summary["task_type"] == "classification" and result.summary["class_balance"]["High"] == 18
    sinks.save_model(result, str(tmp_path / "model"))
    loaded = sinks.load_model(spark, str(tmp_path / "model"))
    a = ml_training.batch_score(result.best, df).select(f"predicted_{target}").collect()
    b = ml_training.batch_score(loaded, df).select(f"predicted_{target}").collect()
    assert a == b
