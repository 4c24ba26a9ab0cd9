"""Self-check of a store without its source.

A generation never changes once it is published. So what each of its directories holds is recorded once, at any time after, and held
against the files as often as wanted: the number of rows, and two sums of row hashes, which depend neither on the order nor on the files.
Sums also tell rows that are doubled. This finds loss, doubling and decay; who rewrites files may rewrite records too, which is what
roots are for.

Hashes are summed before the shuffle, so a task hands on one row a directory. Recording and checking read each stored byte once.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from merklake.operators.joins import small_join
from merklake.plans import store
from merklake.schemas import RECORDS
from merklake.sources.scratch import materialize

# What names a directory below the log, table by table.
DIRECTORY = {"bundles": "part", "tiles": "tile_level", "paths": "part", "hash_index": "prefix_dir", "frontier": None}
KEYS = ["log_id", "generation", "stored_table", "directory"]
TOLERANT = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"}


def _published(manifest: DataFrame) -> DataFrame:
    """log_id, generation of all that the manifest names, but for empty logs, which have no files."""
    named = manifest.where("tree_size > 0").select("log_id", F.explode("generations.generation").alias("generation"))
    return named.distinct().where("generation != ''")


def _row_hash(schema: StructType, salt: int) -> Column:
    """Hash of a whole row. Nulls are told from each other's places, and maps are taken in order."""
    parts = [F.lit(salt)]
    for field in schema.fields:
        value = F.col(field.name)
        parts += [value.isNull(), F.array_sort(F.map_entries(value)) if isinstance(field.dataType, MapType) else value]
    return F.xxhash64(*parts).cast("decimal(20,0)")


def _read(spark: SparkSession, location: str, schema: StructType, **options: str) -> DataFrame:
    """A stored table; one whose folder is gone has no rows."""
    try:
        return spark.read.schema(schema).options(**options).parquet(location)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def contents(spark: SparkSession, location: str, generations: DataFrame, **options: str) -> DataFrame:
    """RECORDS of what the directories of these generations (log_id, generation) hold now."""

    def of_table(table: str) -> DataFrame:
        schema, named = store.TABLES[table], DIRECTORY[table]
        stored = _read(spark, f"{location}/{table}", StructType([*schema.fields, RECORDS["generation"]]), **options)
        hashed = small_join(stored, generations, ["log_id", "generation"], "inner").select(
            "log_id", "generation", F.lit(table).alias("stored_table"), (F.col(named).cast("string") if named else F.lit("")).alias("directory"),
            _row_hash(schema, 1).alias("a"), _row_hash(schema, 2).alias("b"),
        )
        return hashed.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"))

    return reduce(DataFrame.unionByName, [of_table(table) for table in DIRECTORY]).select(*RECORDS.names)


def read_records(spark: SparkSession, location: str) -> DataFrame:
    """What was recorded. Two runs at once record the same, which counts once."""
    return _read(spark, f"{location}/records", RECORDS).distinct()


def record(spark: SparkSession, location: str) -> None:
    """Record what the published generations hold, but for those with a record: what was recorded stays. A run that stops
    has recorded nothing, and can be repeated."""
    known = read_records(spark, location).select("log_id", "generation").distinct()
    new = _published(store.read_manifest(spark, location)).join(known, ["log_id", "generation"], "left_anti")
    contents(spark, location, materialize(new, "unrecorded")).write.mode("append").parquet(f"{location}/records")


def self_check(spark: SparkSession, location: str) -> DataFrame:
    """Directories of the published copies that are not as recorded: log_id, generation, stored_table, directory, problem,
    recorded_rows, found_rows.

    problem: `missing` (nothing can be read there), `unexpected` (not recorded), `rows` (their number differs), `content` (it does not, but
    the rows do), `not_recorded` (a generation without a record; table and directory are null). Files that are gone or cannot be read
    count as having no rows. An empty store and logs of size 0 have no findings; a null log_id has no copy, so none either.
    """
    published = _published(store.read_manifest(spark, location))
    recorded = materialize(read_records(spark, location).join(published, ["log_id", "generation"], "left_semi"), "recorded")
    known = recorded.select("log_id", "generation").distinct()
    found = contents(spark, location, materialize(known, "known"), **TOLERANT)
    was = recorded.select(*KEYS, F.struct("rows", "sum_a", "sum_b").alias("was"))
    both = was.join(found.select(*KEYS, F.struct("rows", "sum_a", "sum_b").alias("now")), KEYS, "full_outer")
    problem = (
        F.when(F.col("now").isNull(), F.lit("missing"))
        .when(F.col("was").isNull(), F.lit("unexpected"))
        .when(F.col("was.rows") != F.col("now.rows"), F.lit("rows"))
        .when(F.col("was") != F.col("now"), F.lit("content"))
    )
    differing = both.select(*KEYS, problem.alias("problem"), F.col("was.rows").alias("recorded_rows"), F.col("now.rows").alias("found_rows"))
    absent = published.join(known, ["log_id", "generation"], "left_anti").withColumn("problem", F.lit("not_recorded"))
    return differing.where("problem is not null").unionByName(absent, allowMissingColumns=True)
