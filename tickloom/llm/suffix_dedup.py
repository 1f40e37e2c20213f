"""Removal of long repeated substrings by distributed two-stage suffix sorting.

Every ``length``-byte string has a minimizer: the least hash among the ``SEED``-byte strings inside it.
Equal strings have equal minimizers, so only strings whose minimizer occurs in two different texts can
repeat. Their maximal runs (all strings that share one minimizer occurrence) are cut out as contexts and
grouped by minimizer. Within a group of distinct contexts the suffixes are sorted in two stages: those
that start with a byte not larger than the next are sorted directly, all others are induced by one scan
over the buckets in ascending order, as a suffix that starts with a larger byte than its successor takes
its place from that successor. Adjacent common prefixes of at least ``length`` then give the groups of equal strings and the
least document of each.

Equal texts are one text with its least doc_id: a later copy of at least ``length`` bytes is removed whole.
Tasks hold one segment or one group of minimizers. Minimizers with more than ``HOT`` distinct
contexts (a very common passage with ever different surroundings) are cut into single strings first,
which spread by their own hash.

Defined cases: null or empty text has no bytes and nothing to remove; null doc_id orders last and
such rows are one document; rows that repeat a doc_id never remove each other's bytes; an empty table gives an empty
result. Texts and minimizers are identified by 64-bit hashes, strings by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bytesops as B
from tickloom.llm.common import doc_order, doc_text, partitions, released, stored, table, tidy

LENGTH, SEED, FLUSH, HELD, HOT = 50, 24, 1 << 19, 40_000, 20_000
NAMES = ["cx", "mh", "ctx", "lo", "hi", "tid", "at"]


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def minimizers(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH):
    """(hash of the seed at each byte, least hash of each string, mixed anew, start allowed): strings inside one text only."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, bool)
    at = np.arange(len(data) - SEED + 1)
    h = B.SpanHash(data)(at, at + SEED)
    low = B.mix(sliding(h, length - SEED + 1, np.minimum))  # one to one; least hashes themselves crowd at small values
    inside = np.ones(n, bool)
    for b in bounds[1:-1]:
        inside[max(0, b - length + 1):b] = False
    return h, low, inside


def seed_hashes(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, h, t, tids) of each task's distinct minimizers, one text each. Those that two of
    its texts hold are known to be shared: they go, under a negative bucket, straight to their texts."""

    def run(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() * 1000
        hold_h, hold_t, size = [], [], 0

        def flush():
            nonlocal hold_h, hold_t, size, serial
            serial += 1
            h, t = np.concatenate(hold_h), np.concatenate(hold_t)
            hold_h, hold_t, size = [], [], 0
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
            h, t = h[new], t[new]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            many = ~first
            many[:-1] |= ~first[1:]
            parts = [(-serial, h[many], t[many])] if many.any() else []
            h, t = h[first], t[first]
            cut = np.searchsorted(h, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
            cut = np.concatenate([[0], cut, [len(h)]])
            parts += [(b, h[x:y], t[x:y]) for b, (x, y) in enumerate(zip(cut, cut[1:])) if y > x]
            rows = []
            for b, h, t in parts:
                tids, local = np.unique(t, return_inverse=True)
                rows.append((b, planes(h), planes(local.astype(np.uint16 if len(tids) < 1 << 16 else np.uint32)), tids.tobytes()))
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]],
                                              ["bucket", "h", "t", "tids"])

        for batch in batches:
            tids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, data, bounds in B.text_slices(batch.column(1)):
                h, low, inside = minimizers(data, bounds)
                if not len(low):
                    continue
                starts = np.flatnonzero(inside)
                change = np.ones(len(starts), bool)
                change[1:] = low[starts[1:]] != low[starts[:-1]]
                doc = np.searchsorted(bounds, starts, "right") - 1
                change[1:] |= doc[1:] != doc[:-1]
                hold_h.append(low[starts[change]])
                hold_t.append(tids[i:j][doc[change]])
                size += int(change.sum())
                if size >= FLUSH:
                    yield flush()
        if size:
            yield flush()

    return texts.select("tid", "text").mapInArrow(run, "bucket int, h binary, t binary, tids binary")


def planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes, ...: neighbours in order share the upper ones, so this compresses."""
    return bytes([x.itemsize]) + np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def flat(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8)
    size = int(raw[0])
    return np.ascontiguousarray(raw[1:].reshape(size, -1).T).view(f"u{size}").ravel()


def shared_seeds(seeds: DataFrame) -> DataFrame:
    """(tid, h): per text the lower halves of the minimizers that another text holds too, as bytes.
    A chance match of halves only adds a context that repeats nothing."""

    def merge(key, rows):
        rows = rows.to_pylist()
        h = np.concatenate([flat(r["h"]) for r in rows])
        t = np.concatenate([np.frombuffer(r["tids"], np.int64)[flat(r["t"])] for r in rows])
        if key[0].as_py() >= 0:
            order = np.lexsort((t, h))
            h, t = h[order], t[order]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.append(starts[1:], len(h))
            several = np.repeat(t[starts] != t[ends - 1], ends - starts)
            h, t = h[several], t[several]
        order = np.argsort(t, kind="stable")
        h, t = h[order], t[order]
        ids, first = np.unique(t, return_index=True)
        ends = np.append(first, len(t))
        return pa.table([pa.array(ids, pa.int64()), pa.array([h[a:b].astype(np.uint32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], ["tid", "h"])

    return seeds.groupBy("bucket").applyInArrow(merge, "tid long, h binary")


def contexts(texts: DataFrame) -> DataFrame:
    """Maximal runs of strings that share one occurrence of a shared minimizer, as two kinds of rows:
    (mh, ctx, lo, hi) for each distinct context of a task's flush with its least and greatest document, and
    (cx, tid, at) for each occurrence."""

    def run(batches):
        held: dict[bytes, list] = {}

        def flush():
            rows = [(mh, ctx, lo, hi) for ctx, (mh, lo, hi) in held.items()]
            held.clear()
            for k in range(0, len(rows), 20_000):
                mh, ctx, lo, hi = zip(*rows[k:k + 20_000])
                n = len(mh)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(n, pa.int64()), pa.array(mh, pa.int64()), pa.array(ctx, pa.binary()), pa.array(lo, pa.int64()),
                     pa.array(hi, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], NAMES)

        for batch in batches:
            tids, dids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, bounds in B.text_slices(batch.column(2)):
                h, low, inside = minimizers(data, bounds)
                if not len(low):
                    continue
                where = np.arange(len(h))
                where = sliding(where, LENGTH - SEED + 1, lambda a, b: np.where(h[b] < h[a], b, a))
                salt = lambda hashes, d: B.mix(hashes + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                seeds = [np.frombuffer(b"".join(x or ()), np.uint32).astype(np.uint64) for x in batch.column(3)[i:j].to_pylist()]
                wanted = np.unique(salt(np.concatenate(seeds), np.repeat(np.arange(j - i), [len(x) for x in seeds])))
                doc = np.searchsorted(bounds, np.arange(len(low)), "right") - 1
                key = salt(low & np.uint64(0xFFFFFFFF), doc)
                at = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
                use = np.flatnonzero(inside & (wanted[at] == key)) if len(wanted) else np.zeros(0, np.int64)
                if not len(use):
                    continue
                new = np.ones(len(use), bool)
                new[1:] = (use[1:] != use[:-1] + 1) | (where[use[1:]] != where[use[:-1]])
                a = use[new]
                b = use[np.append(np.flatnonzero(new)[1:], len(use)) - 1]
                cx = B.SpanHash(data)(a, b + LENGTH).view(np.int64)
                d = doc[a]
                raw, n = data.tobytes(), len(a)
                for x, y, m, who in zip(a.tolist(), b.tolist(), low[a].view(np.int64).tolist(), dids[i:j][d].tolist()):
                    got = held.setdefault(raw[x:y + LENGTH], [m, who, who])
                    if who < got[1]:
                        got[1] = who
                    elif who > got[2]:
                        got[2] = who
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cx), none, pa.nulls(n, pa.binary()), none, none, pa.array(tids[i:j][d]),
                                                  pa.array((a - bounds[d]).astype(np.int32))], NAMES)
                if len(held) >= HELD:
                    yield from flush()
        yield from flush()

    return texts.select("tid", "did", "text", "seeds").mapInArrow(
        run, "cx long, mh long, ctx binary, lo long, hi long, tid long, at int")


def two_stage(t: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH):
    """Sorted starts of all ``length``-byte strings of the contexts t[begin:end], and adjacent common prefixes."""
    n = end - begin - length + 1
    useful = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.zeros(len(t), bool)
    last[end - 1] = True
    after = np.append(t[1:], 0)
    larger = (t > after) & ~last
    need = np.zeros(len(t), bool)
    need[useful] = True
    front = begin + n - 1
    while len(front):  # successors that the last useful suffixes are induced from
        front = front[larger[front]] + 1
        need[front] = True
    direct = np.flatnonzero(need & ~larger)
    stop = end[np.searchsorted(begin, direct, "right") - 1]
    padded = np.append(t, np.zeros(length, np.uint8))
    rows = padded[direct[:, None] + np.arange(length)]
    rows[direct[:, None] + np.arange(length) >= stop[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{length}").ravel(), kind="stable")
    direct = direct[order]
    head = t[direct]
    cut = np.searchsorted(head, np.arange(257))
    induced: list[list] = [[] for _ in range(256)]
    scanned = []
    for c in range(256):
        bucket = np.concatenate([*induced[c], direct[cut[c]:cut[c + 1]]]) if induced[c] else direct[cut[c]:cut[c + 1]]
        if not len(bucket):
            continue
        scanned.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & larger[before]]
        first = t[before]
        for b in np.unique(first):
            induced[b].append(before[first == b])
    sa = np.concatenate(scanned) if scanned else np.zeros(0, np.int64)
    is_useful = np.zeros(len(t), bool)
    is_useful[useful] = True
    sa = sa[is_useful[sa]]
    window = padded[sa[:, None] + np.arange(length)]
    differ = window[1:] != window[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), length)
    return sa, lcp


FIRST = ["cx", "n", "first"]


def with_hash(batches):
    """(cx, ctx, lo): contexts and their own hash."""
    for batch in batches:
        for i, j, data, bounds in B.text_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(B.SpanHash(data)(bounds[:-1], bounds[1:]).view(np.int64)),
                                              batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)], ["cx", "ctx", "lo"])


def earliest(key, rows):
    """(cx, n, first): for each context of a group the least document of each of its n strings, where some
    other document of the context comes later; one value where all n agree."""
    merged: dict[bytes, list] = {}
    for mh, ctx, lo, hi in zip(*[rows.column(c).to_pylist() for c in ("mh", "ctx", "lo", "hi")]):
        got = merged.setdefault(ctx, [mh, lo, hi])
        got[1], got[2] = min(got[1], lo), max(got[2], hi)
    ctx = list(merged)
    mh, lo, hi = (np.array(x, np.int64) for x in zip(*merged.values()))
    # a minimizer that one document holds alone repeats nothing
    _, at = np.unique(mh, return_inverse=True)
    low, high = np.full(at.max() + 1, np.iinfo(np.int64).max), np.full(at.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(low, at, lo)
    np.maximum.at(high, at, hi)
    apart = np.flatnonzero((low < high)[at])
    if not len(apart):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.int64()))], FIRST)
    ctx, lo, hi = [ctx[i] for i in apart], lo[apart], hi[apart]
    t = np.frombuffer(b"".join(ctx), np.uint8)
    size = np.array([len(x) for x in ctx], np.int64)
    end = np.cumsum(size)
    begin = end - size
    cx = B.SpanHash(t)(begin, end).view(np.int64)
    sa, lcp = two_stage(t, begin, end)
    owner = lo[np.searchsorted(begin, sa, "right") - 1]
    starts = np.concatenate([[0], np.flatnonzero(lcp < LENGTH) + 1])
    least = np.full(len(t), -1, np.int64)
    useful = np.zeros(len(t), bool)
    useful[sa] = True
    least[sa] = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(sa))))
    least = least[useful]  # the strings of each context in turn
    n = size - LENGTH + 1
    head = np.cumsum(n) - n
    low, high = np.minimum.reduceat(least, head), np.maximum.reduceat(least, head)
    later = low < hi
    keep = np.repeat(later & (low < high), n)
    keep[head[later]] = True
    count = np.where(low < high, n, 1)[later]
    first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(least[keep]))
    return pa.table([pa.array(cx[later]), pa.array(n[later].astype(np.int32)), first], FIRST)


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with did, rep, tid, n_bytes, sha and, where something may go, text; marks by tid)."""
    spark = docs.sparkSession
    base = docs.select(doc_order().alias("did"), F.xxhash64(doc_text()).alias("tid"), doc_text().alias("text"))
    held = shared_seeds(seed_hashes(base, partitions(spark))).groupBy("tid").agg(F.collect_list("h").alias("seeds"))
    reps = base.groupBy("tid").agg(F.min("did").alias("rep"))
    known = stored(reps.join(held, "tid", "left"), "known")
    tidy(spark)
    joined = base.join(known, "tid").withColumn("n_bytes", F.octet_length("text").cast("long"))
    open_ = (F.col("did") == F.col("rep")) & F.col("seeds").isNotNull()
    texts = stored(joined.select("did", "rep", "tid", "n_bytes", F.when(open_, F.lit(None)).otherwise(F.sha2("text", 256)).alias("sha"),
                                 F.when(open_, F.col("text")).alias("text"), F.when(open_, F.col("seeds")).alias("seeds")), "texts")
    released(spark, known)
    tidy(spark)
    found = stored(contexts(texts.where("text is not null")), "contexts")
    distinct = found.where("ctx is not null").select("mh", "ctx", "lo", "hi")
    # stored, so its size is known: as a rule it is empty and needs no shuffle of the contexts
    many = stored(distinct.groupBy("mh").count().where(F.col("count") > HOT).select("mh"), "hot")
    tidy(spark)
    cold, hot = distinct.join(many, "mh", "left_anti"), distinct.join(many, "mh", "left_semi")
    groups = partitions(spark) * 8
    first = cold.withColumn("part", F.pmod("mh", F.lit(groups))).groupBy("part").applyInArrow(earliest, "cx long, n int, first array<long>")
    hashed = hot.select("ctx", "lo").mapInArrow(with_hash, "cx long, ctx binary, lo long")
    strings = hashed.groupBy("cx").agg(F.first("ctx").alias("ctx"), F.min("lo").alias("lo")).select("cx", "lo", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.length("ctx") - LENGTH + 1), lambda k: F.substring("ctx", k, F.lit(LENGTH)))).alias("k", "s"))
    least = strings.groupBy("s").agg(F.min("lo").alias("low"))
    hot_first = strings.join(least, "s").groupBy("cx").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "low"))), lambda x: x["low"]).alias("first")).select("cx", F.size("first").alias("n"), "first")
    first = stored(first.unionByName(hot_first), "first")
    tidy(spark)
    marks = stored(found.where("tid is not null").select("cx", "tid", "at").join(first, "cx")
                   .groupBy("tid").agg(F.collect_list(F.struct("at", "n", "first")).alias("marks")), "marks")
    released(spark, found, first, many)
    tidy(spark)
    return texts, marks


def covers(marks: pa.Array):
    """(begin, end) of each row's entries and their (first string, number of strings, least document)."""
    size = np.array(marks.value_lengths().fill_null(0), np.int64)
    end = np.cumsum(size)
    each = marks.flatten()
    at, n, first = (each.field(k) for k in range(3))
    at, n = at.to_numpy(zero_copy_only=False).astype(np.int64), n.to_numpy(zero_copy_only=False).astype(np.int64)
    k = np.array(first.value_lengths(), np.int64)
    head = np.cumsum(k) - k
    at = np.repeat(at - head, k) + np.arange(k.sum())
    upto = np.concatenate([[0], np.cumsum(k)])
    return upto[end - size], upto[end], at, np.repeat(np.where(k == 1, n, 1), k), first.flatten().to_numpy(zero_copy_only=False)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>"


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per input row."""
    texts, marks = removed_spans(docs)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            dids = batch.column(0).to_numpy(zero_copy_only=False)
            begin, end, at, width, first = covers(batch.column(2))
            rows, starts, ends, counts = [], [], [], []
            for did, text, x, y in zip(dids.tolist(), batch.column(1), begin.tolist(), end.tolist()):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                use = np.flatnonzero(first[x:y] < did) + x
                a = b = use[:0]
                kept = raw
                if len(use):
                    size = len(raw) + 1
                    edge = np.bincount(at[use], minlength=size) - np.bincount(at[use] + width[use] + LENGTH - 1, minlength=size)
                    gone = np.concatenate([[False], np.cumsum(edge)[:-1] > 0, [False]])
                    a, b = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])
                    kept = raw[~gone[1:-1]]
                rows.append((did, len(raw), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest()))
                starts.append(a)
                ends.append(b)
                counts.append(len(a))
            if not rows:
                continue
            spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts).astype(np.int64)), pa.array(np.concatenate(ends).astype(np.int64))],
                                               ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), spans)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(zip(*rows), kinds)], spans],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    opened = texts.where("text is not null").select("tid", "did", "text").join(marks, "tid", "left").select("did", "text", "marks")
    cut = opened.mapInArrow(run, RESULT)
    whole = (F.col("did") > F.col("rep")) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    rest = texts.where("text is null").select(
        F.col("did").alias("doc_id"), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, F.lit(empty)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(none).alias("spans"))
    return cut.unionByName(rest)


def op3(spark, sf_dir):
    from tickloom.llm.common import NO_ID

    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op3_suffix_array_dedup": (op3, None)}
