"""The registry of logs: log id, frozen time, location."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONFIG_VALUE = "STRUCT<frozenTime: BIGINT, bucketName: STRING>"


def from_entries(entries: DataFrame) -> DataFrame:
    """Registry rows from configuration entries (key STRING, value STRING as JSON).

    A key that is no 64-bit number, or a value that is no such object, gives an `error_code`.
    """
    value = F.from_json("value", CONFIG_VALUE)
    log_id = F.when(F.col("key").rlike(r"^[+-]?[0-9]+$"), F.col("key").try_cast("bigint"))
    parsed = entries.select("*", log_id.alias("log_id"), value.alias("_v"))
    error = F.when(F.col("log_id").isNull(), F.lit("BAD_LOG_ID")).when(F.col("_v").isNull(), F.lit("BAD_VALUE"))
    return parsed.select(
        *[c for c in entries.columns if c not in ("key", "value")],
        "key",
        "log_id",
        # Fields left out have their zero values.
        F.coalesce("_v.frozenTime", F.lit(0)).alias("frozen_time_nanos"),
        F.coalesce("_v.bucketName", F.lit("")).alias("location"),
        error.alias("error_code"),
    )


# A line of a block mapping: indent, key, and maybe a plain or quoted value; a comment may follow.
_YAML_LINE = r"""^( *)("[^"]*"|'[^']*'|[^\s"'#:]+)\s*:(?:\s+("[^"]*"|'[^']*'|[^\s"'#][^#]*?))?(?:\s+#.*|\s*)$"""
_YAML_EMPTY = r"^\s*(#.*|---\s*|\.\.\.\s*)?$"
_FIELDS = {"frozentime": "frozenTime", "bucketname": "bucketName"}


def _json_text(text: Column) -> Column:
    quoted = F.to_json(F.create_map(F.lit("k"), text))
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)


def _yaml_entries(whole: DataFrame) -> DataFrame:
    """Entries (key, value as JSON) of the mapping `logMap` in a YAML text of block mappings: log ids, and below each its fields.

    Names are read in any case. A line of any other form becomes an entry that from_entries() finds bad, and so does a log with a
    value of its own, or a frozen time that is no number.
    Lines are put in order in one task: they are those of one file, which was one value before.
    """
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where(~F.col("line").rlike(_YAML_EMPTY))

    def part(group: int) -> Column:
        return F.regexp_extract("line", _YAML_LINE, group)

    def bare(text: Column) -> Column:
        return F.regexp_replace(F.trim(text), r"""^(["'])(.*)\1$""", "$2")

    formed = F.col("line").rlike(_YAML_LINE)
    read = lines.select(
        "at", formed.alias("formed"), F.when(formed, F.length(part(1))).otherwise(F.lit(0)).alias("indent"),
        F.when(formed, bare(part(2))).otherwise(F.col("line")).alias("key"), F.trim(part(3)).alias("raw"),
    )
    every = Window.partitionBy(F.lit(0))
    so_far = every.orderBy("at")
    section = F.last(F.when(F.col("formed") & (F.col("indent") == 0), F.lower("key")), ignorenulls=True).over(so_far)
    read = read.withColumn("section", section).where("section = 'logmap' or not formed")
    read = read.withColumn("log_indent", F.min(F.when(F.col("indent") > 0, F.col("indent"))).over(every))
    heads = (F.col("indent") == F.col("log_indent")) | ~F.col("formed")
    read = read.withColumn("log", F.last(F.when(heads, F.col("at")), ignorenulls=True).over(so_far)).where("log is not null")

    name = F.coalesce(*[F.when(F.lower("key") == low, F.lit(exact)) for low, exact in _FIELDS.items()], F.col("key"))
    number = F.col("raw").rlike(r"^[+-]?[0-9]+$") & (name == "frozenTime")
    field = F.concat(_json_text(name), F.lit(":"), F.when(number, F.regexp_replace("raw", r"^\+", "")).otherwise(_json_text(bare(F.col("raw")))))
    return read.groupBy("log").agg(
        F.max(F.when(heads, F.col("key"))).alias("key"),
        F.when(~F.bool_or(F.when(heads, F.col("raw") != "").otherwise((name == "frozenTime") & ~number)), F.concat(F.lit("{"), F.array_join(F.collect_list(F.when(~heads, field)), ","), F.lit("}"))).alias("value"),
    ).drop("log")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Registry from a JSON file with one object, log id to {frozenTime, bucketName}, or from the mapping `logMap` of a .yaml or .yml file."""
    whole = spark.read.text(path, wholetext=True)
    if path.lower().endswith((".yaml", ".yml")):
        entries = _yaml_entries(whole)
    else:
        entries = whole.select(F.explode(F.from_json("value", "MAP<STRING, STRING>")))
    registry = from_entries(entries)
    bad = registry.where("error_code is not null").select("key", "error_code").take(20)
    if bad:
        raise ValueError(f"bad registry entries: {[(r.key, r.error_code) for r in bad]}")
    return registry.select("log_id", "frozen_time_nanos", "location")


def first_registered(registrations: DataFrame, order: str) -> DataFrame:
    """One row per log: the registration that came first. Candidates are combined before the shuffle."""
    rest = [c for c in registrations.columns if c not in ("log_id", order)]
    return (
        registrations.where(F.col("log_id").isNotNull())
        .groupBy("log_id")
        .agg(F.min(F.struct(order, *rest)).alias("_first"))
        .select("log_id", *[F.col(f"_first.{c}").alias(c) for c in rest])
    )
