"""Benchmark decontamination with a distributed positional inverted index.

Training documents are cut into segments of a few megabytes. For each segment the index
stores one posting list per benchmark term: the term's positions in the segment, with a gap
between documents so that no phrase crosses them. Terms that no test item holds cannot take part
in a match and are not stored. A search takes each window's terms from the globally rarest to the most
frequent: the rarest list minus its offset gives candidate starts, and every further list, shifted
by its own offset, is intersected with them. A proximity match is a window whose terms
all lie within ``near`` words of an occurrence of its rarest term, in any order.

Items are searched in blocks of about ``BLOCK_WORDS`` words, so what tasks receive is bounded and a
benchmark of any size works.

Defined cases: null or empty text has no words and no hits; items without words have no window;
windows shared by items count for each; repeated rows are judged alike; null item ids are
ignored; an empty benchmark leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bytesops as B
from tickloom.llm.common import stored, table

WINDOW, NEAR, GAP, SEGMENT_BYTES, BLOCK_WORDS = 10, 15, 64, 4 << 20, 1 << 20
SHIFT = np.int64(1) << np.int64(40)
INDEX = "seg long, term int, n long, at binary, docs binary"
HITS = "doc_id long, n_words long, hits array<int>, items array<string>, n_near long, seg long, row int"


def word_hashes(data: np.ndarray, bounds: np.ndarray):
    start, end, doc = B.spans(B.NON_WORD[data], bounds)
    return B.SpanHash(B.TO_LOWER[data])(start, end), doc


def item_words(benchmark: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for i, j, data, bounds in B.text_slices(batch.column(1)):
                words, doc = word_hashes(data, bounds)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(cut), pa.int64()), pa.array(
                    [words[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["item", "n", "words"])

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item string, n long, words binary").where("n > 0")


class Windows:
    """The windows of one block of items: term ids by offset, and the items of each window."""

    def __init__(self, rows):
        words = [np.frombuffer(r["words"], np.uint64) for r in rows]
        self.terms = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        found: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        table = []
        for r, w in zip(rows, words):
            ids = np.searchsorted(self.terms, w).astype(np.int32)
            for k in range(max(1, len(ids) - WINDOW + 1)):
                win = np.full(WINDOW, -1, np.int32)
                part = ids[k:k + WINDOW]
                win[:len(part)] = part
                at = found.setdefault(win.tobytes(), len(table))
                if at == len(table):
                    table.append(win)
                    self.items.append([])
                if not self.items[at] or self.items[at][-1] != r["item"]:
                    self.items[at].append(r["item"])
        self.table = np.array(table, np.int32).reshape(-1, WINDOW)


def build_index(docs: DataFrame, terms: np.ndarray, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Posting lists (seg, term, n, at) and one row per segment with its documents (term -1)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        from pyspark import TaskContext

        vocab = shared.value
        seg = TaskContext.get().partitionId() << 32
        held: dict = {"ids": [], "n": [], "base": [], "tid": [], "at": [], "bytes": 0, "next": 0}

        def flush():
            nonlocal seg
            tid, at = np.concatenate(held["tid"] or [np.zeros(0, np.int32)]), np.concatenate(held["at"] or [np.zeros(0, np.int32)])
            order = np.argsort(tid, kind="stable")
            tid, at = tid[order], at[order]
            t, first = np.unique(tid, return_index=True)
            ends = np.append(first, len(tid))
            doc = np.array([[x if x is not None else -2**63 for x in held["ids"]], held["n"], held["base"]], np.int64).tobytes()
            lists = [np.diff(at[a:b], prepend=0).astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])]
            cols = [pa.array([seg] * (len(t) + 1), pa.int64()), pa.array([-1, *t], pa.int32()),
                    pa.array([len(held["ids"]), *np.diff(ends)], pa.int64()), pa.array([None, *lists], pa.binary()),
                    pa.array([doc] + [None] * len(t), pa.binary())]
            held.update(ids=[], n=[], base=[], tid=[], at=[], bytes=0, next=0)
            seg += 1
            return pa.RecordBatch.from_arrays(cols, ["seg", "term", "n", "at", "docs"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j, data, bounds in B.text_slices(batch.column(1)):
                words, doc = word_hashes(data, bounds)
                n = np.bincount(doc, minlength=j - i)
                base = held["next"] + np.concatenate([[0], np.cumsum(n + GAP)])
                at = np.arange(len(words)) - np.concatenate([[0], np.cumsum(n)])[doc] + base[doc]
                tid = np.searchsorted(vocab, words)
                ok = vocab[np.minimum(tid, len(vocab) - 1)] == words if len(vocab) else np.zeros(len(words), bool)
                held["tid"].append(tid[ok].astype(np.int32))
                held["at"].append(at[ok].astype(np.int64))
                held["ids"] += ids[i:j]
                held["n"] += n.tolist()
                held["base"] += base[:-1].tolist()
                held["next"] = int(base[-1])
                held["bytes"] += len(data)
                if held["bytes"] >= segment_bytes:
                    yield flush()
        if held["ids"]:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


def search(index: DataFrame, windows: Windows, near: int = NEAR) -> DataFrame:
    """Exact and proximity matches by document, from the stored postings of each segment."""
    spark = index.sparkSession
    counts = np.zeros(len(windows.terms) + 1, np.int64)
    # one count per benchmark term of the block: bounded by BLOCK_WORDS
    for r in index.where("term >= 0").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["term"]] = r["n"]
    rarity = np.where(windows.table >= 0, counts[windows.table], np.iinfo(np.int64).max)
    shared = spark.sparkContext.broadcast((windows.table, np.argsort(rarity, axis=1, kind="stable"), windows.items))

    def one(key, rows):
        table, order, items = shared.value
        rows = sorted(rows.to_pylist(), key=lambda r: r["term"])
        ids, n, base = np.frombuffer(rows[0]["docs"], np.int64).reshape(3, -1)
        lists = [np.cumsum(np.frombuffer(r["at"], np.int32), dtype=np.int64) for r in rows[1:]]
        terms = np.array([r["term"] for r in rows[1:]], np.int64)
        keys = np.concatenate([t * SHIFT + x for t, x in zip(terms, lists)] or [np.zeros(0, np.int64)])
        size = np.array([len(x) for x in lists], np.int64)
        begin = np.cumsum(size) - size
        hits, found, close = intersect(table, order, terms, begin, size, keys, near)
        # postings back to documents
        doc = np.searchsorted(base, hits[0], "right") - 1
        length = (table >= 0).sum(1)[hits[1]]
        marks = np.zeros(int(base[-1] + n[-1]) + WINDOW + 2, np.int32) if len(base) else np.zeros(2, np.int32)
        np.add.at(marks, hits[0], 1)
        np.add.at(marks, hits[0] + length, -1)
        hit_at = np.flatnonzero(np.cumsum(marks) > 0)
        hit_doc = np.searchsorted(base, hit_at, "right") - 1
        edges = np.searchsorted(hit_doc, np.arange(len(ids) + 1))
        named: dict[int, set] = {}
        for d, w in set(zip(doc.tolist(), hits[1].tolist())):
            named.setdefault(d, set()).update(items[w])
        near_doc = np.searchsorted(base, close[0], "right") - 1
        pairs = np.unique(near_doc * np.int64(len(table) + 1) + close[1]) // (len(table) + 1)
        n_near = np.bincount(pairs, minlength=len(ids)) if len(pairs) else np.zeros(len(ids), np.int64)
        return pa.table([pa.array([None if x == -2**63 else int(x) for x in ids], pa.int64()), pa.array(n, pa.int64()),
                         pa.array([(hit_at[a:b] - base[i]).astype(np.int32) for i, (a, b) in enumerate(zip(edges, edges[1:]))], pa.list_(pa.int32())),
                         pa.array([sorted(named.get(i, ())) for i in range(len(ids))], pa.list_(pa.string())),
                         pa.array(n_near[:len(ids)], pa.int64()), pa.array([key[0].as_py()] * len(ids), pa.int64()),
                         pa.array(np.arange(len(ids)), pa.int32())], ["doc_id", "n_words", "hits", "items", "n_near", "seg", "row"])

    return index.groupBy("seg").applyInArrow(one, HITS)


def intersect(table, order, terms, begin, size, keys, near):
    """((start, window) of exact matches, their windows, (place, window) of proximity matches)."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(table) or not len(terms):
        return none, None, none
    w = np.arange(len(table))
    rare = table[w, order[:, 0]].astype(np.int64)
    slot = np.searchsorted(terms, rare)
    here = terms[np.minimum(slot, len(terms) - 1)] == rare
    w, slot = w[here], slot[here]
    reps = size[slot]
    win = np.repeat(w, reps)
    take = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(begin[slot], reps)
    place = keys[take] - table[win, order[win, 0]].astype(np.int64) * SHIFT
    start, exact_win = place - order[win, 0], win
    near_place, near_win = place, win
    for k in range(1, WINDOW):
        off = order[exact_win, k]
        term = table[exact_win, off].astype(np.int64)
        ok = (term < 0) | has(keys, term * SHIFT + start + off)
        start, exact_win = start[ok], exact_win[ok]
        term = table[near_win, order[near_win, k]].astype(np.int64)
        low = term * SHIFT + np.maximum(near_place - near, 0)
        at = np.searchsorted(keys, low)
        ok = (term < 0) | ((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] <= term * SHIFT + near_place + near))
        near_place, near_win = near_place[ok], near_win[ok]
    return (start, exact_win), None, (near_place, near_win)


def has(keys, wanted):
    at = np.searchsorted(keys, wanted)
    return (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == wanted)


def contamination(docs: DataFrame, benchmark: DataFrame, near: int = NEAR, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, n_near, contaminated: one row per input row."""
    items = stored(item_words(benchmark), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    found = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        windows = Windows(sorted(part.toArrow().to_pylist(), key=lambda r: r["item"]))
        index = stored(build_index(docs, windows.terms), "postings")
        one = search(index, windows, near)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("seg", "row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sum("n_near").alias("n_near"),
            F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "items", "n_near",
                        (F.size("hits") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without a benchmark window, with all their columns.

    Every row is judged by its own text, whatever its doc_id."""
    own = F.xxhash64(F.col("text").cast("string"))
    bad = contamination(docs.select(own.alias("doc_id"), "text"), benchmark).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), own.alias("_text"))
    return rows.join(bad, F.col("_text") == F.col("_bad"), "left_anti").select("row.*")


def op4(spark, sf_dir):
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                      F.col("n_near").alias("n_proximity"))


QUERIES = {"op4_decontamination": (op4, None)}
