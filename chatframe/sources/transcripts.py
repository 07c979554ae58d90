"""Where conversations come from, and where results go."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Folders that text files are dealt out over.
FOLDERS = 64
#: Names of the roles of the ``conversations`` table in transcripts made from it.
AUTHORS = {"user": "Ada Lovell", "assistant": "Ben Ortiz", "system": "Cleo Marsh"}


def read_pastes(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, raw, file): one row for each text file; the id is a hash of its path."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"))
    return rows.select(F.xxhash64("file").alias("conv_id"), "raw", "file")


def read_table(spark: SparkSession, path: str, id_col: str = "conv_id", raw_col: str = "raw") -> DataFrame:
    return spark.read.parquet(path).select(F.col(id_col).alias("conv_id"), F.col(raw_col).alias("raw"))


def selection_or_paste(selection: Column, paste: Column) -> Column:
    """The selected text, or the whole paste where nothing is selected."""
    return F.coalesce(F.nullif(selection, F.lit("")), paste)


def json_map(c: Column) -> Column:
    """A column of JSON objects as map<string,string>: blank is an empty map; anything but an object
    of strings is null."""
    blank = F.coalesce(F.trim(c), F.lit("")) == ""
    values = F.from_json(F.when(~blank, c), "map<string,variant>")
    texts = F.forall(F.map_values(values), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    whole = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT<"), F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    return F.when(blank, empty).when(whole & F.coalesce(texts, F.lit(False)), F.from_json(c, "map<string,string>"))


def is_valid_json(c: Column) -> Column:
    return (F.coalesce(F.trim(c), F.lit("")) == "") | F.try_parse_json(c).isNotNull()


def write_notes(notes: DataFrame, path: str, col: str = "note", mode: str = "errorifexists") -> None:
    """Notes as Parquet, partition-parallel; ``col`` is the text column beside ``conv_id``."""
    notes.select("conv_id", col).write.mode(mode).parquet(path)


def write_text(notes: DataFrame, path: str, col: str = "note", mode: str = "errorifexists") -> None:
    """Only the texts, as text files."""
    notes.select(F.col(col).alias("value")).write.mode(mode).text(path)


def write_pastes(conversations: DataFrame, path: str) -> None:
    """Each (conv_id, raw) as a text file of its own, ``<folder>/conv_id=<id>.txt``, with a newline
    at its end (empty files aren't read); ``path`` is a new folder that all executors share. Spark's writer would need a folder for each id, takes a
    listing task for each folder, and on a local file system starts several processes for each file."""
    fs, root = pafs.FileSystem.from_uri(path)
    for k in range(FOLDERS):
        fs.create_dir(f"{root}/{k:02d}")

    def write(rows: Iterator[Row]) -> None:
        fs, root = pafs.FileSystem.from_uri(path)
        for conv_id, raw in rows:
            with fs.open_output_stream(f"{root}/{conv_id % FOLDERS:02d}/conv_id={conv_id}.txt") as file:
                file.write((raw or "").encode() + b"\n")

    conversations.select("conv_id", "raw").foreachPartition(write)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")


def author(role: Column) -> Column:
    named = F.lit("Dan Brook")
    for k, v in AUTHORS.items():
        named = F.when(role == k, v).otherwise(named)
    return named


def clock(conv_id: Column, turn: Column) -> Column:
    minute = F.lpad(((conv_id * 7 + turn) % 60).cast("string"), 2, "0")
    return F.concat((turn % 12 + 1).cast("string"), F.lit(":"), minute, F.when(turn % 2 == 0, " AM").otherwise(" PM"))


def messages_of(rows: DataFrame) -> DataFrame:
    """Turns as a message table."""
    return rows.select(
        "conv_id", F.col("turn").alias("msg_idx"), author(F.col("role")).alias("username"), clock(F.col("conv_id"), F.col("turn")).alias("ts_text"), "text", F.lit(None).cast("timestamp").alias("msg_date"),
        F.lit(None).cast("string").alias("avatar"), F.lit(None).cast("string").alias("thread_info"), F.array().cast("array<struct<name:string,count:int>>").alias("reactions"),
        F.lit(False).alias("is_thread_reply"), F.lit(False).alias("is_thread_start"), F.lit(False).alias("is_edited"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"),
    )


def transcripts(rows: DataFrame) -> DataFrame:
    """(conv_id, raw): turns as pasted chat, a header line with a linked clock before each text."""
    place = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    head = F.concat(author(F.col("role")), F.lit("  ["), clock(F.col("conv_id"), F.col("turn")), F.lit("](https://chat.example/archives/C1/p"), place, F.lit(")"))
    said = rows.select("conv_id", "turn", F.concat(head, F.lit("\n"), "text").alias("said"))
    joined = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("s"))
    return joined.select("conv_id", F.array_join(F.transform("s", lambda x: x["said"]), "\n").alias("raw"))
