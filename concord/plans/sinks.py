"""Writers: one artefact a table, by Spark's commit protocol, so that a half-written one is never seen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, *, separator: str = ",", partitions: int | None = None) -> None:
    """A table as CSV with a header; binary columns as hex, arrays and structs as JSON."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.hex(c) if kind == "binary" else F.to_json(c) if kind in ("array", "struct", "map") else c).alias(f.name))
    shaped = df.select(*out)
    (shaped.coalesce(partitions) if partitions else shaped).write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A row a line; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def guide_json(channels: DataFrame, programs: DataFrame, listings: DataFrame) -> DataFrame:
    """doc: a guide's channels with their listings, and its programmes, as JSON documents, one a channel and one a programme."""
    slots = listings.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("start", "minutes", "program"))).alias("listings"))
    a = channels.join(slots, F.col("id") == F.col("channel"), "left").select(F.to_json(F.struct(F.lit("channel").alias("kind"), "id", "name", "listings")).alias("doc"))
    return a.union(programs.select(F.to_json(F.struct(F.lit("program").alias("kind"), "id", "title")).alias("doc")))


def read_guide(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(channels, programs, listings) of what guide_json() made."""
    kinds = "kind string, id long, name string, title string, listings array<struct<start:long,minutes:long,program:long>>"
    rows = docs.select(F.from_json("doc", kinds).alias("x")).select("x.*")
    channels, programs = rows.filter("kind = 'channel'"), rows.filter("kind = 'program'")
    return channels.select("id", "name"), programs.select("id", "title"), channels.select(F.col("id").alias("channel"), F.explode("listings").alias("l")).select("channel", "l.*")


def write_texts(df: DataFrame, path: str, text: str, keys: Sequence[str]) -> None:
    """One folder a key (key=value), with the texts in it."""
    df.select(*keys, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*keys).text(path)


def export_all(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Every table as parquet below folder, under its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def names_from_text(lines: DataFrame) -> DataFrame:
    """id, name from lines `id name` (column value); comments after #, and lines without a number, are left out; the last of an id stays."""
    parsed = lines.select(F.monotonically_increasing_id().alias("_at"), F.regexp_extract("value", r"^\s*(\d+)\s+([^#]*?)\s*(?:#.*)?$", 1).alias("id"), F.regexp_extract("value", r"^\s*(\d+)\s+([^#]*?)\s*(?:#.*)?$", 2).alias("name"))
    return parsed.filter("id <> '' AND name <> ''").groupBy(F.col("id").cast("long").alias("id")).agg(F.max_by("name", "_at").alias("name"))
