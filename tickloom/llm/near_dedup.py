"""Near-duplicate documents by DartMinHash signatures and a banded join.

A document is a weighted set of five-word shingles (weight 1 each, or their counts). Every unit of an
element's weight carries a Poisson process of darts along a rank axis, drawn from hashes of the
element, so all documents see the same darts; a fractional last unit takes the darts whose weight
coordinate lies inside it. A document of total weight W throws the darts of rank up to t / W, about t
whatever its size; each dart falls on one of k coordinates, and each coordinate keeps its
earliest dart. Two signatures agree on a coordinate with probability equal to the weighted Jaccard
similarity. A document with an empty coordinate throws again over twice the ranks.

Equal texts are one class at once. Band keys of their representatives are joined; each member of a
bucket is compared with the bucket's least document, and where a bucket still spans several classes
also with its nearest members by signature and with the member that meets most others in its buckets.
Members of buckets that stay open are joined exactly: shingles are ordered from rare to frequent, and two sets of Jaccard
``threshold`` or more share one among the first few of both (prefix filter), are of like size (length
filter) and have enough left after the first shared one (positional filter). Every link is verified on the
whole shingle sets, and classes are connected components of all links between bucket members.

Defined cases: a text of one to four words is one shingle; null text is empty; texts without words
are near only to equal texts; every text is judged by itself, whatever doc_ids its rows have; null
doc_ids are ordered last; repeated rows share a class; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import bytesops as B
from tickloom.llm.common import NO_ID, doc_order, doc_text, stored, table

SHINGLE, BANDS, ROWS, THRESHOLD, NEIGHBOURS = 5, 20, 4, 0.8, 8
#: slots of the shingle frequencies that order the prefix join
SKETCH = 1 << 20


def shingles(data: np.ndarray, bounds: np.ndarray):
    """(hash, text): five-word shingles of lower-cased words, in order, with repeats."""
    start, end, doc = B.spans(B.BLANK[data], bounds)
    words = B.SpanHash(B.TO_LOWER[data])(start, end)
    n = np.bincount(doc, minlength=len(bounds) - 1)
    h = B.SpanHash(words)
    first = np.arange(len(words))
    begin = np.cumsum(n) - n
    length = np.minimum(n[doc], SHINGLE)
    first = first[first + length <= (begin + n)[doc]]
    return h(first, first + length[first]), doc[first]


def weighted_sets(hashes: np.ndarray, doc: np.ndarray):
    """Distinct elements per text, ordered by text then hash: (hash, text, count)."""
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return h[at], d[at], np.diff(np.append(at, len(h)))


def dart_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """n_docs x k hashes of the earliest dart on each coordinate; rows without weight stay 0."""
    weight = np.asarray(weight, float)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    reach = k * (np.log(k) + 3) / np.maximum(total, 1e-12)
    sig = np.zeros((n_docs, k), np.uint64)
    # one column for each unit of weight
    units = np.ceil(weight).astype(np.int64)
    e = np.repeat(np.arange(len(element)), units)
    unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    part = np.minimum(weight[e] - unit, 1.0)
    seed, column_doc = B.mix(element[e] + unit.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), doc[e]
    todo = total > 0
    while todo.any():
        use = todo[column_doc]
        s, d, p = seed[use], column_doc[use], part[use]
        rank = np.zeros(len(s))
        best = np.full(n_docs * k, np.inf)
        name = np.zeros(n_docs * k, np.uint64)
        step = 0
        while len(s):
            dart = B.mix(s + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
            rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            near = rank <= reach[d]
            s, d, p, rank, dart = s[near], d[near], p[near], rank[near], dart[near]
            where = B.mix(dart)
            inside = (where >> np.uint64(32)).astype(float) * 2.0**-32 < p
            slot = d[inside] * k + ((where[inside] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
            r = rank[inside]
            np.minimum.at(best, slot, r)
            won = r == best[slot]
            name[slot[won]] = dart[inside][won]
            step += 1
        full = ~np.isinf(best).reshape(n_docs, k).any(1) & todo
        sig[full] = name.reshape(n_docs, k)[full]
        todo &= ~full
        reach = reach * 2
    return sig


def signatures(docs: DataFrame, weighting: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(did, t1, t2, keys): hashes of the text and one key per band (null without words)."""

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in B.text_slices(batch.column(3)):
                h, d, count = weighted_sets(*shingles(data, bounds))
                sig = dart_signatures(h, d, count if weighting == "count" else np.ones(len(h)), j - i, bands * rows)
                key = np.zeros((j - i, bands), np.uint64)
                for r in range(rows):
                    key = B.mix(key * np.uint64(31) + sig[:, r::rows][:, :bands])
                empty = np.bincount(d, minlength=j - i) == 0
                keys = [None if x else k.view(np.int64).tolist() for x, k in zip(empty, key)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], batch.column(2)[i:j],
                                                  pa.array(keys, pa.list_(pa.int64()))], ["did", "t1", "t2", "keys"])

    rows_in = docs.select(doc_order().alias("did"), F.xxhash64(doc_text()).alias("t1"), F.xxhash64(F.lit("text"), doc_text()).alias("t2"),
                          doc_text().alias("text"))
    return rows_in.mapInArrow(run, "did long, t1 long, t2 long, keys array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(did, set): sorted distinct shingle hashes as bytes."""

    def run(batches):
        for batch in batches:
            for i, j, data, bounds in B.text_slices(batch.column(1)):
                h, d, _ = weighted_sets(*shingles(data, bounds))
                cut = np.searchsorted(d, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(
                    [h[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["did", "set"])

    return texts.select("did", "text").mapInArrow(run, "did long, set binary")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least ``threshold``."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) < threshold * len(large):
                    keep.append(False)
                    continue
                at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
                common = int((large[at] == small).sum()) if len(large) else 0
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("did").alias("a"), F.col("set").alias("sa")), sets.select(F.col("did").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): least member of each node's component, by label propagation with pointer jumping."""
    both = stored(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
        edges.select(F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "edges")
    labels = stored(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("cw")), "w").groupBy("v").agg(F.min("cw").alias("m"))
        low = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("n"))
        jump = labels.select(F.col("v").alias("n"), F.col("c").alias("up"))
        new = stored(low.join(jump, "n", "left").select("v", "old", F.least("n", F.coalesce("up", "n")).alias("c")), "labels")
        if new.where("c <> old").limit(1).count() == 0:
            return new.select("v", "c")
        labels = new.select("v", "c")


def ordered_pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).distinct()


def open_members(shared: DataFrame, links: DataFrame):
    """Components of the links, and the members of buckets that span several of them with their class ``c``."""
    classes = components(links)
    label = shared.join(classes.select(F.col("v").alias("did"), "c"), "did", "left").withColumn("c", F.coalesce("c", "did"))
    open_ = label.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band", "key")
    return classes, label.join(open_, ["band", "key"])


def prefix_pairs(rest: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes among (did, c, set) that can reach the threshold: every pair that does is there."""

    def slot(h):
        return (B.mix(h) & np.uint64(SKETCH - 1)).astype(np.int64)

    def sizes(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(slot(np.frombuffer(x.as_buffer(), np.uint64)), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    # one count per slot: any order of the shingles gives all pairs, this one keeps frequent ones out of the prefixes
    freq = np.zeros(SKETCH, np.int64)
    counted = rest.select("set").mapInArrow(sizes, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    freq[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    shared = rest.sparkSession.sparkContext.broadcast(freq)

    def prefixes(batches):
        freq = shared.value
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(2)]
            size = np.array([len(x) for x in sets], np.int64)
            k = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            first = [h[np.lexsort((h, freq[slot(h)]))[:n]] for h, n in zip(sets, k)]
            at = np.repeat(np.arange(len(sets)), k)
            place = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            did, c = (batch.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(first).view(np.int64), did, c, size[at], size[at] - place)],
                                                 ["tok", "did", "c", "size", "rest"])

    rows = stored(rest.select("did", "c", "set").mapInArrow(prefixes, "tok long, did long, c long, size long, rest long"), "prefixes")
    mixed = rows.groupBy("tok").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("tok")
    rows = rows.join(mixed, "tok", "left_semi")
    x, y = (rows.select("tok", *[F.col(k).alias(k + i) for k in ("did", "c", "size", "rest")]) for i in "xy")
    need = F.lit(threshold / (1 + threshold)) * (F.col("sizex") + F.col("sizey")) - 1e-6
    return ordered_pairs(x.join(y, "tok").where((F.col("didx") < F.col("didy")) & (F.col("cx") != F.col("cy"))
                                                & (F.least("restx", "resty") >= need)), "didx", "didy")


def near_classes(docs: DataFrame, weighting: str = "set", threshold: float = THRESHOLD, bands: int = BANDS,
                 rows: int = ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(did, t1, t2, rep, class_did, class_t1, class_t2, n_links): one row per input row; ``rep`` is the least document
    of the same text, class_* the class's least document and its text; links counted are those that were looked for."""
    sigs = stored(signatures(docs, weighting, bands, rows), "signatures")
    reps = sigs.groupBy("t1", "t2").agg(F.min_by("keys", "did").alias("keys"), F.min("did").alias("rep"))
    # a text's node is its first hash, or the second where texts share the first
    same = F.row_number().over(Window.partitionBy("t1").orderBy("t2"))
    reps = stored(reps.select("t1", "t2", "keys", "rep", F.when(same == 1, F.col("t1")).otherwise(F.col("t2")).alias("node")), "texts")
    members = reps.where(F.col("keys").isNotNull()).select(F.col("node").alias("did"), "keys")
    bucket = members.select("did", "keys", F.posexplode("keys").alias("band", "key"))
    least = bucket.groupBy("band", "key").agg(F.min("did").alias("first"), F.count("*").alias("n")).where("n > 1")
    # members of buckets with company: what every later round reads
    shared = stored(bucket.join(least, ["band", "key"]).select(
        "did", "band", "key", "first", "n", F.element_at("keys", F.pmod(F.col("band") + 1, F.lit(bands)) + 1).alias("near1"),
        F.element_at("keys", F.pmod(F.col("band") + 2, F.lit(bands)) + 1).alias("near2")), "buckets")
    wanted = shared.select("did").distinct()
    # one row of each text in question
    chosen = reps.join(wanted, F.col("node") == F.col("did")).select("t1", "t2", "rep", "node")
    texts = docs.select(doc_order().alias("rep"), F.xxhash64(doc_text()).alias("t1"), F.xxhash64(F.lit("text"), doc_text()).alias("t2"), doc_text().alias("text"))
    texts = texts.join(chosen, ["rep", "t1", "t2"]).select(F.col("node").alias("did"), "text")
    sets = stored(shingle_sets(texts.dropDuplicates(["did"])), "sets")
    tried = stored(ordered_pairs(shared.where("did <> first"), "first", "did"), "pairs")
    links = stored(verified(tried, sets, threshold), "links")
    classes, split = open_members(shared, links)
    order = Window.partitionBy("band", "key").orderBy("near1", "near2", "did")
    ahead = [F.struct(F.lead("did", i).over(order).alias("d"), F.lead("c", i).over(order).alias("c")) for i in range(1, neighbours + 1)]
    company = split.groupBy("did").agg(F.sum("n").alias("company"))
    hubs = split.join(company, "did").groupBy("band", "key").agg(F.max(F.struct("company", "did", "c")).alias("hub"))
    others = F.concat(F.array(F.struct(F.col("hub.did").alias("d"), F.col("hub.c").alias("c"))), "ahead")
    pairs = split.withColumn("ahead", F.array(*ahead)).join(hubs, ["band", "key"]).select("did", "c", F.explode(others).alias("o"))
    fresh = stored(ordered_pairs(pairs.where("o.d is not null and o.c <> c"), "did", "o.d").join(tried, ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(stored(verified(fresh, sets, threshold), "links"))
    classes, split = open_members(shared, links)
    rest = stored(split.select("did", "c").distinct().join(sets, "did"), "open")
    fresh = stored(prefix_pairs(rest, threshold).join(tried.unionByName(fresh), ["a", "b"], "left_anti"), "pairs")
    links = links.unionByName(stored(verified(fresh, sets, threshold), "links"))
    classes = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    # classes are settled by text before copies come in, so a large group of copies meets one plain join
    by_text = reps.select("t1", "t2", "rep", "node").join(classes.select(F.col("v").alias("node"), "c"), "node", "left").join(degree, "node", "left")
    own = F.struct("rep", "t1", "t2")
    heads = by_text.where("c is not null").groupBy("c").agg(F.min(own).alias("head"))
    by_text = by_text.join(heads, "c", "left").select("t1", "t2", "rep", "count", F.coalesce("head", own).alias("head"))
    return sigs.select("did", "t1", "t2").join(by_text, ["t1", "t2"]).select(
        "did", "t1", "t2", "rep", F.col("head.rep").alias("class_did"), F.col("head.t1").alias("class_t1"), F.col("head.t2").alias("class_t2"),
        F.coalesce("count", F.lit(0)).alias("n_links"))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The least document of each class, with all columns; of rows that repeat its doc_id and text, one."""
    keep = near_classes(docs.select("doc_id", "text"), **options).where("did = class_did and t1 = class_t1 and t2 = class_t2").select(
        F.col("did").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_order().alias("_doc"),
                       F.xxhash64(doc_text()).alias("_t1"), F.xxhash64(F.lit("text"), doc_text()).alias("_t2"))
    key = ["_doc", "_t1", "_t2"]
    return rows.join(keep, key, "left_semi").dropDuplicates(key).select("row.*")


def op10(spark, sf_dir):
    found = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.select(real("did").alias("doc_id"), real("class_did").alias("class_id"), real("rep").alias("text_id"), "n_links")


QUERIES = {"op10_minhash_near_dedup": (op10, None)}
