"""Manifest and file-inventory scans, manifest and result sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow.fs import FileSelector, FileSystem
from pyarrow.lib import ArrowInvalid, ArrowNotImplementedError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file in memory at once, and of the files that one task hashes.
CHUNK_BYTES = 8 << 20
GROUP_BYTES = 256 << 20

FILE_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sha256", T.StringType()),
    ]
)
MANIFEST = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("artifact_id", T.StringType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("files", T.ArrayType(FILE_RECORD)),
    ]
)
CAMPAIGN_RUN = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("phases", T.ArrayType(T.StringType())),
        T.StructField("anchors", T.MapType(T.StringType(), T.StringType())),
        T.StructField("backdated", T.ArrayType(T.StringType())),
        T.StructField("phase_row_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("label_row_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("run_label", T.StringType()),
        T.StructField("label_is_phase_level", T.BooleanType()),
        T.StructField("flow_rows", T.LongType()),
        T.StructField("flow_rows_spanning_boundary", T.LongType()),
        T.StructField("output", T.StringType()),
        T.StructField("output_sha256", T.StringType()),
    ]
)

# Folders and the manifest file that an inventory leaves out.
SKIPPED_FOLDERS = (".artifact-work", "__pycache__", ".pytest_cache", ".git")
MANIFEST_FILE = "artifact-manifest.json"


def manifest_records(documents: DataFrame, text: str = "document") -> DataFrame:
    """File records from manifest JSON texts, with the schema tag each document declares."""
    parsed = documents.select(F.from_json(text, MANIFEST).alias("m"))
    return parsed.select(
        F.col("m.schema").alias("schema_tag"), "m.artifact_id", F.explode("m.files").alias("f")
    ).select("schema_tag", "artifact_id", "f.path", "f.bytes", "f.sha256")


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return manifest_records(text.withColumnRenamed("value", "document"))


def scan_campaign_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per run of a derived-campaign manifest."""
    document = spark.read.option("multiLine", True).schema(
        T.StructType([T.StructField("runs", T.ArrayType(CAMPAIGN_RUN))])
    ).json(path)
    return document.select(F.inline("runs"))


def scan_spec(spark: SparkSession, path: str, expected_tag: str) -> DataFrame:
    """A JSON specification as one nested row, plus whether its schema tag is the expected one."""
    spec = spark.read.option("multiLine", True).json(path)
    return spec.withColumn("tag_ok", F.col("schema").eqNullSafe(F.lit(expected_tag)))


@dataclass
class FileGroup(InputPartition):
    """Files that one task reads: (path, size) each."""

    files: list[tuple[str, int]]


class HashedFileReader(DataSourceReader):
    """Files of a folder in groups of about ``group`` bytes; a larger file is a group of its own."""

    def __init__(self, root: str, chunk: int, group: int):
        self.root, self.chunk, self.group = root, chunk, group

    def partitions(self) -> list[FileGroup]:
        fs, base = FileSystem.from_uri(self.root)
        listed = fs.get_file_info(FileSelector(base, recursive=True))
        groups, size = [FileGroup([])], 0
        for info in sorted((i for i in listed if i.is_file), key=lambda i: i.path):
            if groups[-1].files and size + info.size > self.group:
                groups.append(FileGroup([]))
                size = 0
            groups[-1].files.append((info.path, info.size))
            size += info.size
        return groups

    def read(self, partition: FileGroup) -> Iterator[tuple[str, int, str]]:
        """One running hash per file; a chunk is all of it that is ever in memory."""
        fs, base = FileSystem.from_uri(self.root)
        for path, size in partition.files:
            running = hashlib.sha256()
            with fs.open_input_file(path) as file:
                for start in range(0, size, self.chunk):
                    file.seek(start)
                    running.update(file.read(min(self.chunk, size - start)))
            yield path[len(base.rstrip("/")) + 1:], size, running.hexdigest()


class HashedFiles(DataSource):
    """Source of ``(path, bytes, sha256)`` of all files below the folder in option ``root``."""

    @classmethod
    def name(cls) -> str:
        return "hashed_files"

    def schema(self) -> str:
        return "path string, bytes bigint, sha256 string"

    def reader(self, schema: T.StructType) -> HashedFileReader:
        return HashedFileReader(self.options["root"], int(self.options["chunk"]), int(self.options["group"]))


def _opens(root: str) -> bool:
    """Whether tasks can open files of this store themselves and read ranges."""
    try:
        FileSystem.from_uri(root)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


def file_inventory(spark: SparkSession, root: str, chunk: int = CHUNK_BYTES, group: int = GROUP_BYTES) -> DataFrame:
    """``(path, bytes, sha256)`` of every payload file below ``root``, hashed where it is read.

    Files are read in ranges of ``chunk`` bytes, so they may have any size. A store that only Spark's own
    readers open is read as whole values instead, of at most 2 GB a file.
    """
    if _opens(root):
        spark.dataSource.register(HashedFiles)
        found = spark.read.format(HashedFiles.name()).option("root", root).option("chunk", chunk).option("group", group).load()
    else:
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^[a-z0-9]+:/+", "/")
        full = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
        found = whole.select(
            F.substr(full, F.length(base) + 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
        )
    parts = F.split("path", "/")
    return found.filter(~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))).filter(
        F.element_at(parts, -1) != MANIFEST_FILE
    )


def manifest_totals(inventory: DataFrame, blockers: int = 0) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
    ).withColumn("release_eligible", F.lit(blockers == 0))


def write_manifest(inventory: DataFrame, path: str, artifact_id: str, blockers: int = 0) -> None:
    """Write records and totals as JSON tables, so no single row has to hold every file."""
    inventory.repartitionByRange("path").sortWithinPartitions("path").write.json(f"{path}/files")
    manifest_totals(inventory, blockers).withColumn("artifact_id", F.lit(artifact_id)).write.json(
        f"{path}/summary"
    )


def round_result(value: str | Column, digits: int = 6) -> Column:
    """Half-even rounding of a result value."""
    return F.bround(value, digits)


def result_documents(metrics: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One JSON object per metric row, every double rounded and nulls kept."""
    types = dict(metrics.dtypes)
    fields = [
        (round_result(c, digits) if types[c] == "double" else F.col(c)).alias(c) for c in columns
    ]
    return metrics.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def write_result(metrics: DataFrame, path: str, fmt: str = "json", digits: int = 6) -> None:
    types = dict(metrics.dtypes)
    rounded = metrics.select(
        *[(round_result(c, digits) if types[c] == "double" else F.col(c)).alias(c) for c in metrics.columns]
    )
    rounded.write.format(fmt).save(path)


def nested_members(rows: DataFrame, keys: Sequence[str], member: str, name: str, digits: int = 6) -> DataFrame:
    """One row per ``keys`` with ``name``: a map from the text of ``member`` to a struct of all other columns,
    doubles rounded, in the order of ``member``.

    A map is one value: meant for results, whose members are seeds, schemas or scenarios, not for events.
    Members must be distinct and not null.
    """
    types = dict(rows.dtypes)
    values = [
        (round_result(c, digits) if types[c] == "double" else F.col(c)).alias(c)
        for c in rows.columns if c not in (*keys, member)
    ]
    entry = F.struct(F.col(member).alias("_order"), F.col(member).cast("string").alias("key"), F.struct(*values).alias("value"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["key"], e["value"]))
    return rows.groupBy(*keys).agg(F.map_from_entries(ordered).alias(name))


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object a row, one row a line, nulls written out."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), {"ignoreNullFields": "false"})
    documents.select(text.alias("value")).write.text(path)


def scan_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Written documents under a declared schema; a line that is no such document fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
