"""Stored objects: exact paths and bytes, metadata in a table beside them.

Paths follow the public tile layout, which a partitioned table cannot produce, so a small data
source writes them. Object names can be computed from a checkpoint, so reading needs no listing.
"""

import time
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from merklake.schemas import OBJECT_METADATA, OBJECTS

SINK = "tile_objects"
METADATA_DIR = "_object_metadata"
# Bytes of objects read before they are handed on.
READ_BYTES = 32 << 20


def _open(base: str):
    if "://" in base or base.startswith("file:"):
        return pafs.FileSystem.from_uri(base)
    return pafs.LocalFileSystem(), base


class ObjectSink(DataSource):
    """Writes rows (path, bytes) as objects under the folder given to save()."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def schema(self):
        return OBJECTS

    def writer(self, schema, overwrite):
        return _ObjectWriter(self.options["path"].rstrip("/"))


class _ObjectWriter(DataSourceArrowWriter):
    def __init__(self, base: str):
        self.base = base

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        filesystem, root = _open(self.base)
        attempt = TaskContext.get().taskAttemptId()
        made = set()
        for batch in iterator:
            for path, data in zip(batch.column("path"), batch.column("bytes")):
                target = f"{root}/{path.as_py()}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                # Renamed when whole: a lost task leaves no half object, and its rerun writes the same bytes.
                part = f"{folder}/.part-{attempt}-{target.rsplit('/', 1)[1]}"
                with filesystem.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                filesystem.move(part, target)
        return WriterCommitMessage()


def write_objects(objects: DataFrame, base: str) -> None:
    objects.sparkSession.dataSource.register(ObjectSink)
    objects.select("path", "bytes").write.format(SINK).mode("append").save(base)


def write_metadata(
    objects: DataFrame, base: str, provider: Callable[[Column], Column], existing: Column | None = None
) -> None:
    """Store the metadata of each path. `provider` maps the path column to a map column; null means none.

    Entries of the provider win over existing ones with the same key. An object written again has a
    later version, which readers take.
    """
    given = provider(F.col("path"))
    merged = given if existing is None else merge_metadata(existing, given)
    rows = objects.select("path", merged.alias("metadata"), F.lit(time.time_ns()).alias("version"))
    rows.where("metadata is not null").write.mode("append").parquet(f"{base.rstrip('/')}/{METADATA_DIR}")


def read_metadata(spark: SparkSession, base: str) -> DataFrame:
    """The latest metadata of each path, keys in lower case."""
    stored = spark.read.schema(OBJECT_METADATA).parquet(f"{base.rstrip('/')}/{METADATA_DIR}")
    lowered = F.transform_keys("metadata", lambda k, _: F.lower(k))
    return stored.groupBy("path").agg(F.max_by("metadata", "version").alias("metadata")).select(
        "path", lowered.alias("metadata")
    )


def merge_metadata(existing: Column, given: Column) -> Column:
    """Both maps; `given` wins on equal keys."""
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(
        F.coalesce(existing, empty), lambda k, _: ~F.map_contains_key(F.coalesce(given, empty), k)
    )
    return F.when(existing.isNull() & given.isNull(), F.lit(None)).otherwise(
        F.map_concat(kept, F.coalesce(given, empty))
    )


def fetch_objects(paths: DataFrame, base: str) -> DataFrame:
    """Read rows with a `path`: adds `found` and `bytes`. A missing object is a row, not a failure."""
    from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

    schema = StructType([*paths.schema.fields, StructField("found", BooleanType()), StructField("bytes", BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(base.rstrip("/"))

        def packed(part: pa.RecordBatch, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([d is not None for d in data]), pa.array(data, pa.binary())],
                names=[*part.schema.names, "found", "bytes"],
            )

        for batch in batches:
            start, data, size = 0, [], 0
            for path in batch.column("path"):
                try:
                    with filesystem.open_input_stream(f"{root}/{path.as_py()}") as stream:
                        data.append(stream.read())
                        size += len(data[-1])
                except FileNotFoundError:
                    data.append(None)
                # Handed on by bytes, as one object may be megabytes.
                if size >= READ_BYTES:
                    yield packed(batch.slice(start, len(data)), data)
                    start, data, size = start + len(data), [], 0
            if data:
                yield packed(batch.slice(start, len(data)), data)

    return paths.mapInArrow(read, schema)


def list_objects(spark: SparkSession, base: str, prefix: str, suffix: str) -> DataFrame:
    """Distinct non-empty names between prefix and suffix, from a listing of the prefix's folder that reads no content."""
    folder = prefix.rpartition("/")[0]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix and not set(suffix) & set("/*?[]{}\\"):
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    try:
        listed = reader.load(f"{base.rstrip('/')}/{folder}".rstrip("/")).select("path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        listed = spark.createDataFrame([], "path string")
    root = urlparse(base).path.rstrip("/") + "/"
    found = listed.select(F.substring_index("path", root, -1).alias("path")).where(
        F.startswith("path", F.lit(prefix)) & F.endswith("path", F.lit(suffix))
    )
    name = F.substring(
        "path", F.lit(len(prefix) + 1), F.greatest(F.length("path") - (len(prefix) + len(suffix)), F.lit(0))
    )
    return found.select(name.alias("name")).where("name <> ''").distinct()
