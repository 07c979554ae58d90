"""Text files, one for each conversation."""

from pyspark.sql import functions as F

from chatframe.sources import transcripts as source


def test_pastes_are_one_file_each_in_few_folders(spark, tmp_path):
    """Files keep texts whole, with a newline at the end, and folders (each takes a listing task) don't grow with the conversations."""
    texts = {-5: "ends in two\n\n", 0: "", 3: "a\r\nb é\U0001f600", 64: "x" * 100_000, **{k: f"text {k}" for k in range(1000, 1300)}}
    source.write_pastes(spark.createDataFrame(list(texts.items()), "conv_id long, raw string"), f"{tmp_path}/pastes")
    files = [p for p in (tmp_path / "pastes").rglob("*") if p.is_file()]
    assert len(files) == len(texts) and len({p.parent for p in files}) <= source.FOLDERS
    rows = source.read_pastes(spark, f"{tmp_path}/pastes/*").select(F.regexp_extract("file", r"conv_id=(-?\d+)", 1).cast("bigint"), "raw")
    assert dict(rows.collect()) == {k: f"{t}\n" for k, t in texts.items()}


def test_pastes_of_none(spark, tmp_path):
    source.write_pastes(spark.createDataFrame([], "conv_id long, raw string"), f"{tmp_path}/none")
    assert source.read_pastes(spark, f"{tmp_path}/none/*").count() == 0
