"""Line deduplication over levelled sorted runs of line hashes (DataFrame functions only).

Documents arrive in batches of ascending id. The index is a set of runs, each sorted by line
hash and disjoint from the others. A batch reduces its lines to (hash, first document),
merge-anti-joins every run and adds what is left as a run of level 0; as soon as a level holds
``fanout`` runs they are merged into one run of the next level. A line is then kept only
where the index names its own document.

Defined cases: null or empty text is one empty line; keys shorter than ``min_chars`` code
points are never dropped; a null doc_id orders last and all such rows are one document; rows
that repeat a doc_id belong to one document; an empty table gives an empty result. Columns of
the input are carried in one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, doc_order, doc_text, released, shared_dir, stored, table

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, BATCHES, FANOUT = 10, 4, 3
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, th, pos, h1, h2): every line whose key is long enough; two 64-bit hashes stand for the key."""
    lines = docs.select(doc_order().alias("did"), F.xxhash64(doc_text()).alias("th"),
                        F.posexplode(F.split(doc_text(), "\n")).alias("pos", "line"))
    keys = lines.select("did", "th", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= min_chars)
    return keys.select("did", "th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("line"), "k").alias("h2"))


class RunIndex:
    """Levelled runs of (h1, h2, first): sorted by hash, disjoint, stored in the shared folder."""

    def __init__(self, spark, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, {}

    def runs(self) -> list[DataFrame]:
        return [r for level in sorted(self.levels) for r in self.levels[level]]

    def _sorted(self, df: DataFrame, level: int) -> DataFrame:
        return stored(df.select(*KEY, "first").sortWithinPartitions(*KEY), f"run{level}")

    def add(self, lines: DataFrame) -> None:
        """Index a batch whose documents all order after those already indexed."""
        new = lines.groupBy(*KEY).agg(F.min("did").alias("first"))
        for run in self.runs():
            new = new.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self.levels.setdefault(0, []).append(self._sorted(new, 0))
        self.compact()

    def compact(self) -> None:
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            old = self.levels.pop(level)
            merged = old[0]
            for run in old[1:]:
                merged = merged.unionByName(run)
            merged = self._sorted(merged.repartition(*KEY), level + 1)
            released(self.spark, *old)
            self.levels.setdefault(level + 1, []).append(merged)
            level += 1

    def table(self) -> DataFrame | None:
        out = None
        for run in self.runs():
            out = run if out is None else out.unionByName(run)
        return out


def dropped_positions(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT,
                      min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, th, dropped): sorted 0-based positions of the lines that an earlier document already holds."""
    spark = docs.sparkSession
    cuts = docs.select(doc_order().alias("did")).agg(
        F.percentile_approx("did", [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    batch = sum((F.when(F.col("did") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    path = shared_dir(spark, "lines")
    keyed_lines(docs, min_chars).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    schema = "did long, th long, pos int, h1 long, h2 long, batch int"
    lines = spark.read.schema(schema).parquet(path)
    index = RunIndex(spark, fanout)
    for b in range(len(set(cuts)) + 1):
        index.add(lines.where(F.col("batch") == b).select("did", *KEY))
    held = lines.join(index.table(), KEY).where(F.col("first") < F.col("did"))
    return held.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """(row, n_lines, n_dropped, kept): ``row`` is the whole input row, ``kept`` its text without repeated lines."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_order().alias("did"),
                       doc_text().alias("body"), F.xxhash64(doc_text()).alias("th"))
    joined = rows.join(dropped_positions(docs, **options), ["did", "th"], "left")
    lines = joined.select("row", "body", F.coalesce("dropped", F.array().cast("array<int>")).alias("d"),
                          F.split("body", "\n").alias("lines"))
    m, n = F.size("d"), F.size("lines")

    def piece(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("d", i - 1) + 1)
        end = F.when(i == m, n).otherwise(F.get("d", i))
        return F.slice("lines", start + 1, end - start)

    kept = F.when(m == 0, F.col("body")).otherwise(
        F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), m), piece)), "\n"))
    return lines.select("row", n.cast("long").alias("n_lines"), m.cast("long").alias("n_dropped"), kept.alias("kept"))


def op1(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (k) GROUP BY doc_id"""
QUERIES = {"op1_line_dedup": (op1, SQL)}
