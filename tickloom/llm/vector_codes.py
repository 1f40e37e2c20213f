"""Product codes of vectors by Lloyd rounds that look only at active entries.

Vectors are scaled to integers and cut into equal parts; every part position has a codebook. Vectors are stored
once with their state: the assigned entry and its exact distance, per part. In a round, a part whose
assigned entry did not move in the last update compares its stored distance with the moved entries alone (an unmoved
entry lost to it before and loses again); every other part is compared with all entries. Distances are integers: matrix
products of doubles while all terms stay below 2**53, 64-bit integers beyond. Tasks add up their
parts per entry, and the sums of all tasks meet by entry. Only codebooks (parts x entries x part length integers,
bounded by the parameters and the vector length) pass through the driver.

Defined cases: null vectors and vectors with a null, NaN or infinite component are dropped; vectors are filled with
zeros to the longest length, rounded up to a multiple of the number of parts (an empty vector is all zeros); a null vec_id
orders after all others; equal vec_ids follow the order of their components; with fewer rows than entries the codebook has
one entry per row; labels that are null count as one label; an empty table gives an empty result; more columns are ignored.
Components whose squared distances would not fit into a long raise ``ArithmeticError``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import released, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: a label's rows are dealt to so many groups where its total is joined back
SALT = 32
STATE = "vec_id long, label string, v array<long>, code array<int>, distance array<long>"


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    whole = "forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return (rows.selectExpr("cast(vec_id as long) as vec_id", "cast(label as string) as label",
                            "cast(embedding as array<double>) as embedding")
            .where(f"embedding is not null and {whole}")
            .selectExpr("vec_id", "label", f"transform(embedding, x -> cast(floor({scale} * x) as long)) as v"))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, squared distance) of the nearest entry of every row; the first of several."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * max(x.shape[1], 1) * top * top < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    else:
        d = np.stack([((x - e) ** 2).sum(1) for e in entries], 1)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at].astype(np.int64)


def reassigned(x: np.ndarray, code: np.ndarray, distance: np.ndarray, entries: np.ndarray, moved: np.ndarray):
    """New (code, distance) of one part position after the entries ``moved`` changed place."""
    code, distance = code.copy(), distance.copy()
    lost = moved[code]
    full = np.flatnonzero(lost)
    if len(full):
        code[full], distance[full] = nearest(x[full], entries)
    active, kept = np.flatnonzero(moved), np.flatnonzero(~lost)
    if len(active) and len(kept):
        at, d = nearest(x[kept], entries[active])
        at = active[at]
        better = (d < distance[kept]) | ((d == distance[kept]) & (at < code[kept]))
        code[kept[better]], distance[kept[better]] = at[better], d[better]
    return code, distance


def matrix(column, width: int) -> np.ndarray:
    """A list column, all lists of ``width``, as a matrix."""
    flat = column.flatten() if len(column) else pa.array([], column.type.value_type)
    return np.asarray(flat).reshape(len(column), width)


def assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """State under ``books`` (part, entry, position); ``moved`` is None before the first round."""
    shared = state.sparkSession.sparkContext.broadcast((books, moved))  # bounded by the parameters
    parts, _, length = books.shape

    def run(batches):
        books, moved = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2), parts * length).reshape(batch.num_rows, parts, length)
            if moved is not None:
                old, far = matrix(batch.column(3), parts), matrix(batch.column(4), parts)
            codes, distances = np.empty(v.shape[:2], np.int32), np.empty(v.shape[:2], np.int64)
            for p in range(parts):
                x = np.ascontiguousarray(v[:, p])
                if moved is None:
                    codes[:, p], distances[:, p] = nearest(x, books[p])
                else:
                    codes[:, p], distances[:, p] = reassigned(x, old[:, p], far[:, p], books[p], moved[p])
            step = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.ListArray.from_arrays(step, pa.array(codes.ravel())),
                 pa.ListArray.from_arrays(step, pa.array(distances.ravel()))], ["vec_id", "label", "v", "code", "distance"])

    return state.select("vec_id", "label", "v", "code", "distance").mapInArrow(run, STATE)


def entry_sums(state: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, n, sums): one partial sum per task and entry, then one sum per entry."""
    parts, entries, length = shape

    def partial(batches):
        sums, n = np.zeros((parts * entries, length), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(0), parts * length).reshape(batch.num_rows * parts, length)
            at = (matrix(batch.column(1), parts) + np.arange(parts) * entries).ravel()
            np.add.at(sums, at, v)
            n += np.bincount(at, minlength=len(n))
        used = np.flatnonzero(n)
        step = pa.array(np.arange(0, len(used) * length + 1, length or 1, dtype=np.int32)[:len(used) + 1] if length
                        else np.zeros(len(used) + 1, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array((used // entries).astype(np.int32)), pa.array((used % entries).astype(np.int32)),
                                          pa.array(n[used]), pa.ListArray.from_arrays(step, pa.array(sums[used].ravel()))],
                                         ["part", "entry", "n", "sums"])

    def total(rows: pa.Table) -> pa.Table:
        sums = matrix(rows.column("sums").combine_chunks(), length).sum(0)
        return pa.table({"part": rows.column("part")[:1], "entry": rows.column("entry")[:1],
                         "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()),
                         "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

    schema = "part int, entry int, n long, sums array<long>"
    return state.select("v", "code").mapInArrow(partial, schema).groupBy("part", "entry").applyInArrow(total, schema)


def quantize(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, distance) of every kept vector, and the final codebooks (part, entry, position)."""
    kept = stored(integer_vectors(rows, scale), "vectors")
    width, top = kept.agg(F.max(F.size("v")), F.max(F.expr("array_max(transform(v, x -> abs(cast(x as double))))"))).first()
    length = -(-(width or 0) // parts)
    if 4 * parts * length * (top or 0) ** 2 >= 1 << 63:
        raise ArithmeticError(f"components up to {top} have squared distances beyond a long")
    filled = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * length) - F.size("v"))))
    state = filled.selectExpr("*", "cast(null as array<int>) as code", "cast(null as array<long>) as distance")
    first = filled.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # one codebook
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, length).transpose(1, 0, 2).copy()
    if not first:
        return state.select("vec_id", "label", "code", "distance"), books
    moved, before = None, kept
    for _ in range(rounds):
        state = stored(assigned(state, books, moved), "codes")
        released(state.sparkSession, before)
        before, new = state, books.copy()
        for r in entry_sums(state, books.shape).collect():  # at most one row per entry
            new[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
        moved, books = (new != books).any(2), new
    out = stored(assigned(state, books, moved).select("vec_id", "label", "code", "distance"), "codes")
    released(out.sparkSession, before)
    return out, books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds the error summed over each label. Totals are met by (label, salt), so a hot label spreads over ``SALT`` groups."""
    salted = codes.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)))
    totals = (codes.groupBy("label").agg(F.sum("error").alias("label_error"))
              .select(F.col("label").alias("of_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("of_salt")))
    meets = F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt"))
    return salted.join(totals, meets).drop("salt", "of_label", "of_salt")


def op11(spark, sf_dir):
    codes, books = quantize(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    codes = codes.select("vec_id", "label", F.expr("lower(array_join(transform(code, c -> lpad(hex(c), 2, '0')), ''))").alias("code"),
                         F.expr("aggregate(distance, 0L, (a, x) -> a + x)").alias("error"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error",
                                          F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL, every round in full: all entries are compared with all parts."""
    ctes = [f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
            f"""part AS (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x
 FROM kept, range({parts}) AS t(p))""",
            f"""book0 AS (SELECT p, e, x AS y FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part)
 WHERE e < {entries})"""]
    for r in range(rounds + 1):
        ctes.append(f"""code{r} AS (SELECT a.vec_id, a.label, a.p, any_value(a.x) AS x, min(d * 1024 + e) // 1024 AS far, min(d * 1024 + e) % 1024 AS e
 FROM (SELECT part.*, book{r}.e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM part JOIN book{r} USING (p)) AS a GROUP BY a.vec_id, a.label, a.p)""")
        if r < rounds:
            ctes.append(f"""mean{r} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (
 SELECT p, e, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
 FROM (SELECT p, e, unnest(x) AS c, unnest(range(len(x))) AS i FROM code{r}) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS (SELECT p, e, coalesce(mean{r}.y, book{r}.y) AS y FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return f"""WITH {", ".join(ctes)},
digest AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
 FROM (SELECT p, e, unnest(y) AS c, unnest(range(len(y))) AS i FROM book{rounds})),
vec AS (SELECT vec_id, label, string_agg(printf('%02x', e::INTEGER), '' ORDER BY p) AS code, sum(far)::BIGINT AS error
 FROM code{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM vec, digest"""


QUERIES = {"op11_vector_codes": (op11, oracle())}
