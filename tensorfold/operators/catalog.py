"""Lookups in a catalog: keys, shapes, files, aliases, rules and uniqueness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tensorfold.errors import DuplicateTensor, UnknownTensor


def keys(catalog: DataFrame) -> DataFrame:
    return catalog.select("path", "off_start", "name").orderBy("path", "off_start").select("name")


def shape_of(catalog: DataFrame, name: str) -> list[int]:
    """The shape of one tensor; UnknownTensor if no file has it."""
    found = catalog.where(F.col("name") == name).select("shape").first()
    if found is None:
        raise UnknownTensor(f"no tensor is named {name}")
    return list(found[0])


def filename_of(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path) for each name asked for; an empty path where no file has it."""
    return names.join(catalog.select("name", "path"), "name", "left").withColumn("path", F.coalesce("path", F.lit("")))


def file_metadata(catalog: DataFrame) -> DataFrame:
    """(path, key, value) of the files' string maps."""
    return catalog.groupBy("path").agg(F.first("metadata").alias("m")).select("path", F.explode("m").alias("key", "value"))


def duplicate_names(catalog: DataFrame, name: str = "name") -> DataFrame:
    return catalog.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(catalog: DataFrame) -> DataFrame:
    if found := duplicate_names(catalog).limit(5).collect():
        raise DuplicateTensor(f"names in more than one place: {', '.join(sorted(r[0] for r in found))}")
    return catalog


def layout(catalog: DataFrame) -> DataFrame:
    """Adds off_start and off_end, back to back in the order of ``ord`` within ``path``."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return catalog.withColumn("off_end", F.sum("nbytes").over(w)).withColumn("off_start", F.col("off_end") - F.col("nbytes"))


def gaps(catalog: DataFrame) -> DataFrame:
    """Rows of a catalog whose start is not the end of the tensor before them in their file."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("off_start", "off_end")
    return catalog.withColumn("expected", F.coalesce(F.lag("off_end").over(w), F.lit(0))).where("expected <> off_start")


def dim_rule(name: Column, rules: list[tuple[str, int]], default: int = -1) -> Column:
    """The dimension of the first rule whose pattern matches at the start of the name."""
    return reduce(lambda out, r: F.when(name.rlike(f"^(?:{r[0]})"), r[1]).otherwise(out), reversed(rules), F.lit(default))


def key_rules(manifest: dict, model: str) -> list[tuple[str, int]]:
    """Rules of a manifest's ``keys``: whole tensors first, then dimensions 0 and 1; a layer prefix goes before each pattern."""
    found = manifest[model].get("keys", {})
    prefix = found.get("layer_prefix", "")
    return [(prefix + p, dim) for kind, dim in (("all", -1), ("dim_0", 0), ("dim_1", 1)) for p in found.get(kind, [])]


def manifest_files(manifest: dict, model: str, world: int) -> dict[int, list[str]]:
    """Files by rank for a world size; a manifest's ``world_size_0`` serves where there is no entry of its own."""
    found = manifest[model]
    chosen = found.get(f"world_size_{world}") or found.get("world_size_0") or {}
    return {int(k.removeprefix("rank_")): list(v) for k, v in chosen.items()}


def resolve_alias(wanted: DataFrame, aliases: DataFrame, catalog: DataFrame) -> DataFrame:
    """(name, resolved): the name if the catalog has it, else its first alias (least ord) that it has, else the name."""
    known = catalog.select(F.col("name").alias("known")).distinct()
    direct = wanted.join(known, F.col("name") == F.col("known"), "left").withColumnRenamed("known", "direct")
    by_alias = aliases.join(known, F.col("alias") == F.col("known")).groupBy("name").agg(F.min_by("alias", "ord").alias("by_alias"))
    return direct.join(by_alias, "name", "left").select("name", F.coalesce("direct", "by_alias", "name").alias("resolved"))
