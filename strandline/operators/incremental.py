"""Incremental maintenance: fingerprints, work lists, merges, guards and comparisons of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-1 of the sorted rows of a (small) registry, nulls as empty."""
    line = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return rows.agg(F.sha1(F.array_join(F.sort_array(F.collect_list(line)), "|")).alias("fingerprint"))


def file_fingerprints(scan: DataFrame) -> DataFrame:
    """Path, size and time of every file of a scan."""
    return scan.select(F.col("_metadata.file_path").alias("path"), F.concat_ws(":", F.col("_metadata.file_size").cast("string"), F.unix_micros(F.col("_metadata.file_modification_time")).cast("string")).alias("fingerprint")).distinct()


def changed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, state) of entries that were added, removed or have another fingerprint."""
    both = old.select(key, F.col("fingerprint").alias("o")).join(new.select(key, F.col("fingerprint").alias("n")), key, "full_outer")
    state = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """What is wanted and not there yet."""
    return wanted.join(present.select(key).distinct(), key, "left_anti")


def batches(work: DataFrame, key: str, size: int) -> DataFrame:
    """Work in numbered batches, by key."""
    return work.withColumn("batch", F.floor((F.row_number().over(W.orderBy(key)) - 1) / size))


def merge(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """New values over old ones, in one full outer join."""
    a = old.select(key, *(F.col(v).alias(f"o_{v}") for v in values))
    b = new.select(key, *(F.col(v).alias(f"n_{v}") for v in values), F.lit(True).alias("fresh"))
    both = a.join(b, key, "full_outer")
    return both.select(key, *(F.when(F.col("fresh"), F.col(f"n_{v}")).otherwise(F.col(f"o_{v}")).alias(v) for v in values))


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in order; combined before the shuffle."""
    columns = [c for c in rows.columns if c not in keys]
    ordered = rows.select(*keys, F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)), *columns).alias("s"))
    return ordered.groupBy(*keys).agg(F.min("s").alias("s")).select(*keys, *(F.col(f"s.{c}").alias(c) for c in columns))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Equal-key lookup that fails where a key is missing."""
    found = rows.join(table.withColumn("_found", F.lit(True)), key, "left")
    sure = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string"))).cast("boolean"))
    return found.where(sure).drop("_found")


def shrink_guard(old_count: int, new_count: int, least: float = 0.8) -> None:
    """Refuses to replace a product by one with far fewer parts."""
    if new_count < least * old_count:
        raise ValueError(f"{new_count} parts would replace {old_count}")


def difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shares of cells that differ or exist on one side only."""
    both = a.select(*keys, F.col(value).alias("x"), F.lit(1).alias("ia")).join(b.select(*keys, F.col(value).alias("y"), F.lit(1).alias("ib")), keys, "full_outer")
    lone = F.col("ia").isNull() | F.col("ib").isNull()
    return both.agg(F.count("*").alias("cells"), F.count_if(lone).alias("alone"), F.count_if(~lone & ~F.col("x").eqNullSafe(F.col("y"))).alias("differing"))


def combined(version: str, *sources: Column) -> Column:
    """Fingerprint of a version and the sources that a product depends on, nulls as empty."""
    return F.concat_ws("|", F.lit(version), *(F.coalesce(s.cast("string"), F.lit("")) for s in sources))


def outdated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries whose products are to be dropped: changed or removed ones. A first run, without old entries, drops nothing."""
    return changed(old, new, key).where("state <> 'added'").select(key)


def to_compute(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries to compute, with the reason: added and changed ones; all of them as soon as one was removed, for global
    products hold what it gave."""
    states = changed(old, new, key)
    removed = states.agg(F.coalesce(F.bool_or(F.col("state") == "removed"), F.lit(False)).alias("all"))  # one row
    known = new.select(key).join(states, key, "left").crossJoin(F.broadcast(removed))
    return known.where(F.col("all") | F.col("state").isNotNull()).select(key, F.coalesce("state", F.lit("all")).alias("state"))


def read_through(wanted: DataFrame, cache: DataFrame, key: str, value: str, compute) -> DataFrame:
    """(key, value, cached) for all of ``wanted (key, fingerprint)``: from the cache where the fingerprint agrees and the value
    is whole, else from ``compute``, which gets the wanted rows that are missing. A null value counts as missing."""
    whole = cache.where(F.col(value).isNotNull()).dropDuplicates([key, "fingerprint"])
    hits = wanted.join(whole.select(key, "fingerprint", value), [key, "fingerprint"])
    fresh = compute(wanted.join(whole.select(key, "fingerprint"), [key, "fingerprint"], "left_anti"))
    return hits.select(key, value, F.lit(True).alias("cached")).unionByName(fresh.select(key, value, F.lit(False).alias("cached")))


def matching(files: DataFrame, column: str, patterns: tuple[str, ...]) -> DataFrame:
    """Files that any of the patterns fits, each once; a caller lists them (dry run) or deletes them."""
    fits = F.lit(False)
    for p in patterns:
        fits = fits | F.col(column).like(p)
    return files.where(fits)
