"""Audit log files: plain or gzipped JSON, alone or inside tar archives.

Files are read by Spark's binary source.  Python only turns bytes into text
(gunzip, archive members); splitting a file into records and everything after
it is expressed with built-in functions.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

# fixed values: names the reader accepts
SUFFIXES = (".json", ".json.gz", ".gz", ".tar", ".tar.gz", ".tgz")
ARCHIVES = (".tar", ".tar.gz", ".tgz")

# the same suffixes as one case-insensitive Hadoop glob (".gz" covers the two-part names)
SUFFIX_GLOB = "*.{[jJ][sS][oO][nN],[gG][zZ],[tT][aA][rR],[tT][gG][zZ]}"

TEXT_SCHEMA = "source string, file_name string, text string, reason string, counts_as_file boolean"
_FILE_SCHEMA = "Records array<string>, _corrupt string"


def read_log_files(spark: SparkSession, path: str, any_suffix: bool | None = None) -> DataFrame:
    """One row per log file or archive member: its text, or why it could not be read.

    A path to one file is read whatever its name is; in a folder only the
    supported suffixes are taken.
    """
    use_utc(spark)
    if any_suffix is None:
        any_suffix = _is_file(spark, path)
    reader = spark.read.format("binaryFile")
    if not any_suffix:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIX_GLOB)
    return reader.load(path).select("path", "content").mapInPandas(_texts, TEXT_SCHEMA)


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path belongs to, which may be remote; a pattern is no file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(place) and files.getFileStatus(place).isFile()


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in TEXT_SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            for row in _members(path, content):
                yield pd.DataFrame([row], columns=columns)


def _members(path: str, content: bytes) -> Iterator[tuple]:
    if not path.lower().endswith(ARCHIVES):
        yield _decoded(path, posixpath.basename(path), content)
        return
    mode = "r:gz" if path.endswith((".tar.gz", ".tgz")) else "r"
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode=mode) as archive:
            for member in archive:
                if member.isfile() and member.name.endswith(SUFFIXES):
                    label, name = f"{path}::{member.name}", posixpath.basename(member.name)
                    try:
                        data = archive.extractfile(member).read()
                    except Exception as exc:  # one bad member does not stop the archive
                        yield label, name, None, type(exc).__name__, True
                        continue
                    yield _decoded(label, name, data)
    except Exception as exc:
        yield path, posixpath.basename(path), None, type(exc).__name__, False


def _decoded(label: str, name: str, data: bytes) -> tuple:
    try:
        plain = gzip.decompress(data) if name.endswith(".gz") else data
        return label, name, plain.decode("utf-8"), None, True
    except Exception as exc:
        return label, name, None, type(exc).__name__, True


def split_records(files: DataFrame) -> DataFrame:
    """One row per entry of each file's ``Records`` list, plus one row per unreadable file.

    Records stay JSON text until they are split, so the size of a file is not
    bound by the size limit of a single VARIANT value.  The entry index counts
    skipped entries too.
    """
    parsed = files.withColumn(
        "file", F.from_json("text", _FILE_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    is_json = F.json_object_keys("text").isNotNull() | F.json_array_length("text").isNotNull()
    is_object = F.ltrim("text").startswith("{")
    readable = is_object & F.col("file.Records").isNotNull()
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(
        ~F.coalesce(readable, F.lit(False)),
        F.when(F.col("file._corrupt").isNull() | is_json, "ValueError").otherwise("JSONDecodeError"),
    )
    # parsed inside the generator, so that a filter on the record does not parse it again
    entries = F.transform(F.when(reason.isNull(), F.col("file.Records")),
                          lambda entry: F.when(F.ltrim(entry).startswith("{"), F.try_parse_json(entry)))
    exploded = parsed.select(
        "source", "file_name", "counts_as_file", reason.alias("file_reason"),
        F.posexplode_outer(entries).alias("pos", "record"),
    )
    return exploded.withColumn("entry_reason", F.when(
        F.col("file_reason").isNull() & F.col("pos").isNotNull() & F.col("record").isNull(), "NonObjectRecord"))


def records(split: DataFrame) -> DataFrame:
    """Accepted records with their provenance."""
    return split.where(F.col("record").isNotNull()).select(
        F.col("source").alias("source_file_path"),
        F.col("file_name").alias("source_file_name"),
        F.col("pos").cast("long").alias("record_index_in_file"),
        F.current_timestamp().alias("ingest_ts_utc"),
        "record",
    )


def ingest_errors(split: DataFrame) -> DataFrame:
    """Quarantine: unreadable files and entries that are not objects."""
    return split.where(F.col("file_reason").isNotNull() | F.col("entry_reason").isNotNull()).select(
        "source", F.when(F.col("file_reason").isNotNull(), "file").otherwise("record").alias("level"),
        F.coalesce("file_reason", "entry_reason").alias("reason"), "pos",
    )


def ingest_metrics(split: DataFrame) -> DataFrame:
    """One row of totals; unreadable files count as read, except archives that never opened."""
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return split.agg(
        F.count_if(first & F.col("counts_as_file")).alias("total_files_read"),
        F.count_if(F.col("record").isNotNull()).alias("total_records_parsed"),
        F.count_if(F.col("file_reason").isNotNull()).alias("total_malformed_files"),
        F.count_if(F.col("entry_reason").isNotNull()).alias("total_malformed_records"),
    )
