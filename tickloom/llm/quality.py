"""Quality rules: text statistics and a calibrated n-gram logistic regression, scored in Arrow batches.

Features are hashed words and hashed byte 4-grams, each as its share of the text's words or
4-grams, so a margin is a bias plus two means of looked-up weights. The model is fitted on about
``max_train_rows`` labelled documents (chosen by a hash of the id); a quarter of them is held out
of the fit and calibrates the probability (Platt). A document is rejected by the base rule or where
the probability of good quality is below a fixed threshold.

Defined cases: null or empty text has no words and fails the base rule; labels that are null or other
than 0/1 are ignored; several labels of a document count by their least; with labels of
one class only (or none) the base rule alone decides and the probability is null; repeated
rows are scored alike; an empty table gives an empty result; other columns pass unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bytesops as B
from tickloom.llm.common import table

DIM, MAX_TRAIN_ROWS, THRESHOLD, ROUNDS, DECAY = 1 << 14, 4096, 0.2, 80, 1e-4
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: documents that a pass of the fit takes at once
BLOCK_ROWS = 256
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STAT_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    n = len(bounds) - 1
    h = B.SpanHash(data)
    start, end, doc = B.spans(B.BLANK[data], bounds)
    words = h(start, end)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out = {"n_words": np.bincount(doc, minlength=n), "word_chars": B.per_text(lead[end] - lead[start], doc, n),
           "n_symbols": sym[bounds[1:]] - sym[bounds[:-1]]}
    # lines with a word that equal an earlier line of the text
    ls, le, ld = B.spans(data == 10, bounds)
    count = np.concatenate([[0], np.cumsum(~B.BLANK[data])])
    worded = count[le] > count[ls]
    ls, le, ld = ls[worded], le[worded], ld[worded]
    distinct = np.unique(B.mix(h(ls, le) + ld.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out["n_dup_lines"] = np.bincount(ld, minlength=n) - np.bincount(ld[distinct], minlength=n)
    # words covered by an 8-word window that occurs twice or more in the text
    covered = np.zeros(len(words) + 1, np.int64)
    if len(words) >= WINDOW:
        w = B.SpanHash(words)
        first = np.arange(len(words) - WINDOW + 1)
        first = first[doc[first] == doc[first + WINDOW - 1]]
        key = B.mix(w(first, first + WINDOW) + doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = first[counts[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    repeated = np.cumsum(covered)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[repeated], minlength=n)
    return out | {"_words": words, "_doc": doc}


def ngrams(data: np.ndarray, bounds: np.ndarray, words: np.ndarray, word_doc: np.ndarray):
    """(feature, text, share): words in [0, DIM), byte 4-grams in [DIM, 2 DIM)."""
    n = len(bounds) - 1
    at = np.arange(max(0, len(data) - 3))
    gram_doc = np.searchsorted(bounds, at, "right") - 1
    inside = at + 4 <= bounds[gram_doc + 1]
    at, gram_doc = at[inside], gram_doc[inside]
    d = data.astype(np.uint32)
    g = d[at] | d[at + 1] << 8 | d[at + 2] << 16 | d[at + 3] << 24
    g = (g * np.uint32(0x9E3779B1)) >> np.uint32(18)
    feature = np.concatenate([(words & np.uint64(DIM - 1)).astype(np.int32), g.astype(np.int32) + DIM])
    doc = np.concatenate([word_doc, gram_doc])
    n_words, n_grams = np.maximum(np.bincount(word_doc, minlength=n), 1), np.maximum(np.bincount(gram_doc, minlength=n), 1)
    share = np.concatenate([1.0 / n_words[word_doc], 1.0 / n_grams[gram_doc]])
    return feature, doc, share


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, idx, val): distinct features of each text, for training."""

    def run(batches):
        for batch in batches:
            ids, marks = batch.column(0), batch.column(1)
            for i, j, data, bounds in B.text_slices(batch.column(2)):
                s = statistics(data, bounds)
                f, d, share = ngrams(data, bounds, s["_words"], s["_doc"])
                key, inverse = np.unique(d.astype(np.int64) * (2 * DIM) + f, return_inverse=True)
                val = np.bincount(inverse, weights=share, minlength=len(key)).astype(np.float32)
                cut = np.searchsorted(key, np.arange(j - i + 1) * (2 * DIM))
                idx = (key % (2 * DIM)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [ids[i:j], marks[i:j], pa.array([idx[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([val[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["doc_id", "quality", "idx", "val"])

    return docs.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, quality int, idx binary, val binary")


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """Weights and calibration from about ``max_train_rows`` labelled documents."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = known.count()
    keep = min(1.0, max_train_rows / max(total, 1))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("train")), F.lit(1 << 20))
    # about max_train_rows ids whatever the size of the tables: small enough to broadcast
    sample = known.where(place < int(keep * (1 << 20))).select("doc_id", "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    y, held, blocks = blocks_of(feature_rows(texts).toArrow())
    if len(set(y)) < 2:
        return None
    w, b = descend(blocks, y, ~held)
    margin = np.full(len(y), b)
    for rows, idx, val, doc in blocks:
        margin[rows] += np.bincount(doc, weights=w[idx] * val, minlength=len(rows))
    on = held if len(set(y[held])) == 2 else ~held
    return {"w": w, "b": b, "platt": platt(margin[on], y[on])}


def blocks_of(table: pa.Table):
    """(labels, held out, blocks) of the documents in ascending order: a block is (rows, idx, val, place in rows) of the documents
    of one kind, held out or not, among ``BLOCK_ROWS``. Passes over blocks keep the driver's working arrays small."""
    order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
    y = table.column("quality").to_numpy()[order].astype(float)
    held = np.arange(len(y)) % 4 == 3
    blocks = []
    for i in range(0, len(y), BLOCK_ROWS):
        for kind in (False, True):
            rows = i + np.flatnonzero(held[i:i + BLOCK_ROWS] == kind)
            if len(rows):
                idx, val = ([np.frombuffer(table.column(c)[int(k)].as_buffer(), dtype) for k in order[rows]]
                            for c, dtype in (("idx", np.uint16), ("val", np.float32)))
                doc = np.repeat(np.arange(len(rows), dtype=np.uint16), [len(x) for x in idx])
                blocks.append((rows, np.concatenate(idx), np.concatenate(val), doc))
    return y, held, blocks


def descend(blocks, y, on):
    """Full-batch Adam on the logistic loss with weight decay; features are scaled by their spread."""
    blocks = [x for x in blocks if on[x[0][0]]]
    n = max(on.sum(), 1)
    spread = np.zeros(2 * DIM)
    for _, idx, val, _ in blocks:
        np.add.at(spread, idx.astype(np.intp), val.astype(float) ** 2)
    scale = 1.0 / np.sqrt(spread / n + 1e-9)
    w, b = np.zeros(2 * DIM), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        g, r = np.zeros_like(w), np.zeros(len(y))
        for rows, idx, val, doc in blocks:
            idx = idx.astype(np.intp)
            x = val * scale[idx]
            z = b + np.bincount(doc, weights=w[idx] * x, minlength=len(rows))
            r[rows] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / n
            np.add.at(g, idx, r[rows][doc] * x)
        g, gb = g + DECAY * w, r.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w, b = w - 0.02 * (m / a) / (np.sqrt(v / c) + 1e-9), b - 0.02 * (mb / a) / (np.sqrt(vb / c) + 1e-9)
    return w * scale, b


def platt(margin, y):
    """(slope, intercept) of the calibrated probability, by damped Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s = margin.std() + 1e-9
    x = np.stack([margin / s, np.ones_like(margin)], 1)
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        ab = ab - np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - t) + 1e-3 * ab), -2, 2)
    return max(float(ab[0] / s), 0.0), float(ab[1])


def scored(batch: pa.RecordBatch, text_at: int, model: dict | None, threshold: float) -> dict[str, np.ndarray]:
    parts = []
    for _i, _j, data, bounds in B.text_slices(batch.column(text_at)):
        s = statistics(data, bounds)
        words, doc, n = s.pop("_words"), s.pop("_doc"), len(bounds) - 1
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
        p = np.full(n, np.nan)
        if model:
            f, d, share = ngrams(data, bounds, words, doc)
            z = model["b"] + np.bincount(d, weights=model["w"][f] * share, minlength=n)
            p = 1 / (1 + np.exp(-np.clip(model["platt"][0] * z + model["platt"][1], -30, 30)))
        parts.append(s | {"base_failed": failed, "quality_score": p, "kept": ~failed & ~(p < threshold)})
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]} if parts else {}


def quality_scores(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = scored(batch, 1, shared.value, threshold)
                cols = [batch.column(0)] + [pa.array(s[k], pa.int64()) for k in STAT_NAMES]
                cols += [pa.array(s["base_failed"]), pa.array(s["kept"]), pa.array(s["quality_score"], from_pandas=True)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *STAT_NAMES, "base_failed", "kept", "quality_score"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in STAT_NAMES) + ", base_failed boolean, kept boolean, quality_score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scored(batch, text_at, shared.value, threshold)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_quality_rules": (op6, None)}
