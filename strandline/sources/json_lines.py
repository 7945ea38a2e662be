"""JSON-lines sources and verified exports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEST_ITEM = "question string, ground_truth string, ground_truth_context string, tags array<string>"


class ExportRefused(ValueError):
    """An export that must not be loaded."""


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """``question, ground_truth, gold_urls, tags`` of a file of test items; blank lines are skipped.

    The gold context is a url or a list of urls; blank urls are left out; missing tags are an empty list.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    item = F.from_json("value", TEST_ITEM)
    rows = lines.select(item.alias("i"))
    raw = F.coalesce("i.ground_truth_context", F.lit(""))
    urls = F.when(F.startswith(F.trim(raw), F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return rows.select("i.question", "i.ground_truth", F.filter(urls, lambda u: F.trim(u) != "").alias("gold_urls"), F.coalesce("i.tags", F.array().cast("array<string>")).alias("tags"))


def read_labeled(spark: SparkSession, path: str, labels: tuple[str, ...] = ("faithful", "unfaithful")) -> DataFrame:
    """``id, score, label``; an unknown label fails the read."""
    rows = spark.read.schema("id string, score double, label string").json(path)
    return rows.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null"))))))


def read_canary(spark: SparkSession, path: str) -> DataFrame:
    """``id, query, answer, contexts, label, note`` of a file of canary items; an unknown label fails the read, a missing note is empty."""
    schema = "id string, query string, answer string, contexts array<string>, label string, note string"
    rows = spark.read.schema(schema).json(path).where("id is not null")
    known = F.when(F.col("label").isin("faithful", "unfaithful"), F.col("label"))
    checked = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("label", F.lit("null")))).cast("string"))
    return rows.withColumn("label", checked).withColumn("note", F.coalesce("note", F.lit("")))


def load_test_set(spark: SparkSession, path: str | None = None, synthetic: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The hand-written test set at ``path``, or the one that ``synthetic`` makes; an error without either."""
    if path is not None:
        return read_test_set(spark, path)
    if synthetic is None:
        raise ValueError("no path of a test set and nothing that makes one")
    return synthetic()


def read_means(spark: SparkSession, folder: str, metrics: list[str]) -> DataFrame:
    """``mode`` and one column for each metric of the result files ``<mode>.json`` of a folder; a metric that a file lacks is null."""
    means = ", ".join(f"`{m}`: double" for m in metrics)
    rows = spark.read.schema(f"means struct<{means}>").option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    mode = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.select(mode.alias("mode"), *(F.col("means")[m].alias(m) for m in metrics))


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read in blocks by one task, whatever its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p in b.column(0).to_pylist():
                files, name = pyarrow.fs.FileSystem.from_uri(p)
                digest = hashlib.sha256()
                with files.open_input_stream(name) as f:
                    while block := f.read(1 << 20):
                        digest.update(block)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(out)], ["digest"])

    return spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(run, "digest string").first()["digest"]


def read_export(spark: SparkSession, folder: str, index: str, schema: str, key: str = "id") -> DataFrame:
    """The rows of one index of an export, refused before anything is written unless its manifest holds for them.

    Checked: the index is listed and complete, the file has the listed SHA-256 and number of rows, no key repeats, no
    column is missing.
    """
    manifest = spark.read.text(f"{folder}/manifest.json", wholetext=True).first()
    entry = json.loads(manifest[0])["indexes"].get(index) if manifest else None
    if not entry or not entry.get("complete"):
        raise ExportRefused(f"{index}: not listed, or not complete")
    path = f"{folder}/{entry['file']}"
    if not spark.read.format("binaryFile").load(path).select("length").take(1) or file_digest(spark, path) != entry["sha256"]:
        raise ExportRefused(f"{index}: the file is not the one that was exported")
    rows = spark.read.schema(schema).json(path)
    present = {c for (c,) in spark.read.text(path).select(F.explode(F.json_object_keys("value"))).distinct().collect()}  # names of columns
    if lacking := set(rows.columns) - present:
        raise ExportRefused(f"{index}: no column {sorted(lacking)}")
    n, ids = rows.agg(F.count("*"), F.countDistinct(key)).first()
    if n != entry["exported"] or n != entry["expected"] or ids != n:
        raise ExportRefused(f"{index}: {n} rows with {ids} ids, {entry['expected']} expected")
    return rows
