"""A step ledger: what a chain of steps has finished, so that a run that died resumes at the step that failed.

Under the ledger's folder a run is ``<chain>/<content key>/<number>``; each finished step leaves one small JSON file in
it, put there whole and only where none stands. The content key is a hash of the chain's input rows and
parameters: the same input resumes its unfinished run, other input begins another.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def get_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str, scratch: str) -> bool:
    """Create a small file whole or not at all; False where one of that name stands already.

    The text is written beside (in ``scratch``) and renamed without overwriting, so no reader sees half of it.
    """
    fs, at = file_system(spark, path)
    _, draft = file_system(spark, f"{scratch}/{uuid.uuid4().hex}")
    if fs.exists(at):
        return False
    stream = fs.create(draft, False)
    stream.writeUTF(text)
    stream.close()
    fs.mkdirs(at.getParent())
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = gateway.new_array(rename, 1)
    options[0] = getattr(rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(at), options)
    except Exception:
        fs.delete(draft, False)
        if fs.exists(at):
            return False
        raise
    return True


def content_key(df: DataFrame, **parameters) -> str:
    """A key of the rows (in any order, repeated rows counted), the columns and the parameters: one aggregate."""
    cols = sorted(df.columns)
    rows = df.select(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col(c).cast("decimal(20,0)")) for c in ("a", "b")]).first()
    text = json.dumps([cols, [str(x) for x in sums], sorted(parameters.items())], default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class Run:
    """One run of a chain: the steps it has finished and what each left."""

    def __init__(self, spark: SparkSession, root: str, chain: str, content: str, number: int):
        self.spark, self.root, self.path = spark, root, f"{root}/{chain}/{content}/{number:06d}"
        self.key = f"{chain}-{content}-{number:06d}"

    @property
    def steps(self) -> dict[str, dict]:
        return {n: json.loads(get_text(self.spark, f"{self.path}/{n}")) for n in names(self.spark, self.path)}

    @property
    def finished(self) -> bool:
        return "done" in names(self.spark, self.path)

    def step(self, name: str, work: Callable[[], dict]) -> dict:
        """What the step left; ``work`` is called only where it has left nothing yet."""
        if name in names(self.spark, self.path):
            return json.loads(get_text(self.spark, f"{self.path}/{name}"))
        outcome = work()
        put_new(self.spark, f"{self.path}/{name}", json.dumps(outcome, default=str), f"{self.root}/scratch")
        return json.loads(get_text(self.spark, f"{self.path}/{name}"))  # of two runners the first to finish counts


def begin(spark: SparkSession, root: str, chain: str, content: str, state: dict, resumable: Callable[[Run], bool]) -> Run:
    """The run to go on with: an unfinished one that is still ``resumable``, a finished one if the table still is as it left it
    (``state``), else a new one that records ``state``."""
    known = [int(n) for n in names(spark, f"{root}/{chain}/{content}")]
    if known:
        last = Run(spark, root, chain, content, known[-1])
        if last.steps["done"].get("state") == state if last.finished else resumable(last):
            return last
    run = Run(spark, root, chain, content, (known[-1] if known else 0) + 1)
    run.step("begin", lambda: state)
    return run
