"""Versioned bar tables: a manifest of file ranges, and merges that read and write only the ranges they touch.

Under the table's folder lie ``data/<id>`` (Parquet files, range-partitioned by scale, symbol and time),
``manifest/<id>`` (one row per file and series in it: rows and time range) and ``commit/<number>``, a small file that
names a manifest. A version exists once its commit file does; it is put there last, whole, and only where none of that
number stands, so a writer that dies leaves the version before it untouched, and of two writers that started from the same
version one fails with :class:`Conflict` instead of undoing the other. Old versions stay readable until ``vacuum``.

A merge finds the files whose series and time range overlap the incoming rows by an equi-join on the series, merges those
with the incoming rows, writes the result as new files, and carries all other files over by name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.plans.maintenance import merge_update
from tickloom.sources import ledger
from tickloom.sources.store import BAR_COLUMNS, BAR_SCHEMA, absent, check_bars, remove

MANIFEST = "path string, scale string, symbol string, n_rows long, first_ts timestamp, last_ts timestamp"
SERIES = ("scale", "symbol")


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to create."""


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n) for n in ledger.names(spark, f"{root}/commit")]


def _manifest_path(spark: SparkSession, root: str, version: int) -> str:
    return ledger.get_text(spark, f"{root}/commit/{version:012d}")


def _commit(spark: SparkSession, root: str, version: int, manifest: str) -> int:
    if not ledger.put_new(spark, f"{root}/commit/{version:012d}", manifest, f"{root}/scratch"):
        raise Conflict(f"version {version} of {root} exists")
    return version


def find(spark: SparkSession, root: str, key: str, after: int) -> int | None:
    """The version after ``after`` that was committed under a key."""
    own = (v for v in versions(spark, root) if v > after and _manifest_path(spark, root, v).rsplit("/", 1)[1].startswith(f"{key}."))
    return next(own, None)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """One row per file and series of a version (the newest by default); empty for an absent table."""
    known = versions(spark, root)
    if version is not None and version not in known:
        raise ValueError(f"{root} has no version {version}")
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(_manifest_path(spark, root, known[-1] if version is None else version))


def _read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], BAR_SCHEMA)


def open_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version. File names pass through the driver, as with any file listing."""
    return _read_files(spark, [r.path for r in manifest(spark, root, version).select("path").distinct().collect()])


def _write_files(df: DataFrame, root: str, files: int | None) -> DataFrame:
    """Write ``df`` as new files and return their manifest rows."""
    spark, at = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    order = ("scale", "symbol", "ts")
    ranged = df.select(*BAR_COLUMNS)
    ranged = ranged.repartitionByRange(files, *order) if files else ranged.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("compression", "zstd").parquet(at)
    return spark.read.schema(BAR_SCHEMA).parquet(at).groupBy(F.col("_metadata.file_path").alias("path"), *SERIES).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def touched(files: DataFrame, incoming: DataFrame, bucket: str = "month") -> DataFrame:
    """Paths of the files whose range of some series overlaps the incoming rows of a time bucket."""
    ranges = incoming.groupBy(*SERIES, F.date_trunc(bucket, "ts").alias("_b")).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    hit = files.join(ranges, list(SERIES)).filter((F.col("lo") <= F.col("last_ts")) & (F.col("hi") >= F.col("first_ts")))
    return hit.select("path").distinct()


def _publish(spark: SparkSession, root: str, base: int, rows: DataFrame, key: str | None = None) -> int:
    at = f"{root}/manifest/{key + '.' if key else ''}{uuid.uuid4().hex}"
    rows.select(*[c.split()[0] for c in MANIFEST.split(", ")]).coalesce(1).write.parquet(at)
    return _commit(spark, root, base + 1, at)


def create(bars: DataFrame, root: str, *, files: int | None = None, validate: bool = True) -> int:
    """Write a whole table as the next version."""
    if validate:
        bad = {k: v for k, v in check_bars(bars).first().asDict().items() if v and k != "n_rows"}
        if bad:
            raise ValueError(f"bars break the table contract: {bad}")
    spark = bars.sparkSession
    known = versions(spark, root)
    return _publish(spark, root, known[-1] if known else 0, _write_files(bars, root, files))


def replaced_by(threshold: float) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Merge in which diverging rows take the incoming values and missing rows are added."""
    return lambda stored, incoming: merge_update(stored, incoming, threshold=threshold).select(*BAR_COLUMNS)


def merge(incoming: DataFrame, root: str, how: Callable[[DataFrame, DataFrame], DataFrame], *, files: int | None = None,
          base: int | None = None, key: str | None = None) -> int:
    """Merge rows into the newest version (or into ``base``, to be refused if it is no longer the newest).

    ``how`` gets the rows of the touched files and the incoming rows. Returns the new version. With a ``key`` and a
    ``base`` the merge happens once: a version committed under that key since is returned as it stands.
    """
    spark = incoming.sparkSession
    known = versions(spark, root)
    start = (known[-1] if known else 0) if base is None else base
    return rewrite(spark, root, touched(manifest(spark, root, start or None), incoming), lambda stored: how(stored, incoming),
                   files=files, base=start, key=key)


def rewrite(spark: SparkSession, root: str, hit: DataFrame, change: Callable[[DataFrame], DataFrame], *, base: int,
            files: int | None = None, key: str | None = None) -> int:
    """Put ``change`` of the rows of some files (column ``path``) in their place; all other files are carried over by name."""
    done = find(spark, root, key, base) if key else None
    if done is not None:
        return done
    old = manifest(spark, root, base or None)
    paths = [r.path for r in hit.collect()]  # names of files, bounded by the table's file count
    new = _write_files(change(_read_files(spark, paths)), root, files)
    kept = old.filter(~F.col("path").isin(paths)) if paths else old
    return _publish(spark, root, base, kept.unionByName(new), key)


def read_touched(spark: SparkSession, root: str, incoming: DataFrame, version: int) -> DataFrame:
    """The rows of those files of a version that incoming rows overlap."""
    return _read_files(spark, [r.path for r in touched(manifest(spark, root, version or None), incoming).collect()])


def open_series(spark: SparkSession, root: str, symbols: DataFrame, version: int) -> DataFrame:
    """All bars of some symbols in a version, from the files that hold any."""
    paths = manifest(spark, root, version or None).join(symbols.select("symbol"), "symbol", "left_semi").select("path").distinct()
    return _read_files(spark, [r.path for r in paths.collect()]).join(symbols.select("symbol"), "symbol", "left_semi")


def n_rows(spark: SparkSession, root: str, version: int) -> int:
    """Rows of a version, from its manifest."""
    return (manifest(spark, root, version).agg(F.sum("n_rows")).first()[0] or 0) if version else 0


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Forget all but the newest ``keep`` versions and delete the folders that none of the others names.

    Run it while nothing is being written: folders of an unfinished version count as unnamed.
    """
    known = versions(spark, root)
    for v in known[:-keep]:
        remove(spark, f"{root}/commit/{v:012d}")
    named = set()
    for v in known[-keep:]:
        at = _manifest_path(spark, root, v)
        named.add(at.rsplit("/", 1)[1])
        named |= {r.path.rsplit("/", 2)[1] for r in manifest(spark, root, v).select("path").distinct().collect()}
    for part in ("data", "manifest"):
        for name in ledger.names(spark, f"{root}/{part}"):
            if name not in named:
                remove(spark, f"{root}/{part}/{name}")


def create_view(spark: SparkSession, name: str, path: str, columns: dict[str, str]) -> DataFrame:
    """A persistent SQL view over one stored folder, after a check of the columns and types it must show."""
    try:
        have = {f.name: f.dataType.simpleString() for f in spark.read.parquet(path).schema}
    except AnalysisException as e:
        if absent(e):
            raise ValueError(f"nothing stored at {path}") from e
        raise
    wrong = {c: have.get(c) for c, t in columns.items() if have.get(c) != t}
    if wrong:
        raise ValueError(f"view {name}: columns {wrong} differ from {columns}")
    shown = ", ".join(f"`{c}`" for c in columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {shown} FROM parquet.`{path}`")
    return spark.table(name)
