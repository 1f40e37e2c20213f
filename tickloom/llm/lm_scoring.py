"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words with at least ``SYMBOL_SHARE`` of the training tokens, and one symbol for all
other words. A context of up to ``DEPTH`` symbols is a candidate if it makes up at least ``CONTEXT_SHARE`` of
the training tokens, and is retained if its next-symbol distribution diverges from its parent's (the
context without its oldest symbol): count times Kullback-Leibler divergence of at least ``DIVERGENCE``
nats. Next symbols below ``NEXT_SHARE`` of a context and ``MASS`` pseudo-counts go to
the parent, down to the add-one base distribution, so every state's distribution sums to one. A
token is scored in the state of the longest retained suffix of its history; within the symbol of other
words it takes its share of the base distribution. Histories start empty in each document.

The shares bound the model (at most DEPTH / CONTEXT_SHARE states of 1 / NEXT_SHARE symbols), so
it may be sent to every task. Word counts have no bound: segments of documents exchange
their distinct words with hash buckets, which return the global counts.

Defined cases: null or empty text is its end token alone; null doc_id is trained on; repeated
rows count as often as they appear; without training tokens N = V = 0 and every score is that of an
unknown word; an empty table gives an empty result. Words are identified by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import bytesops as B
from tickloom.llm.common import partitions, stored, table

SEGMENT_BYTES, FOLDS, HELD_FOLD = 4 << 20, 7, 2
SYMBOL_SHARE, CONTEXT_SHARE, NEXT_SHARE, DEPTH, DIVERGENCE, MASS = 2e-5, 2e-4, 1e-3, 3, 10.0, 20.0
END = np.uint64(1)
SEGMENT = "seg long, ids binary, n binary, held binary, tokens binary, vocab binary, counts binary"


def zipped(x: np.ndarray) -> bytes:
    """Bytes in planes (all first bytes, all second bytes, ...), which compress well."""
    return zlib.compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def unzipped(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def is_held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_FOLD


def segments(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Blocks of documents as local word numbers with the words' hashes and training counts."""

    def run(batches):
        from pyspark import TaskContext

        seg = TaskContext.get().partitionId() << 32
        ids, ns, words, size = [], [], [], 0

        def flush():
            nonlocal seg, ids, ns, words, size
            vocab, local = np.unique(np.concatenate(words), return_inverse=True)
            n = np.concatenate(ns)
            held = np.array([is_held(i) for i in ids], bool)
            counts = np.bincount(local[np.repeat(~held, n)], minlength=len(vocab)).astype(np.uint32)
            row = [[seg], [np.array([-2**63 if i is None else i for i in ids], np.int64).tobytes()], [n.astype(np.int64).tobytes()],
                   [held.tobytes()], [zipped(local.astype(np.uint32))], [zipped(vocab)], [zipped(counts)]]
            seg, ids, ns, words, size = seg + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *[pa.array(x, pa.binary()) for x in row[1:]]],
                                              ["seg", "ids", "n", "held", "tokens", "vocab", "counts"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, j, data, bounds in B.text_slices(batch.column(1)):
                start, end, doc = B.spans(B.BLANK[data], bounds)
                h = B.SpanHash(B.TO_LOWER[data])(start, end)
                n = np.bincount(doc, minlength=j - i)
                out = np.full(len(h) + j - i, END, np.uint64)
                out[np.arange(len(h)) + doc] = h
                words.append(out)
                ns.append(n + 1)
                ids += keys[i:j]
                size += len(data)
                if size >= segment_bytes:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SEGMENT)


def word_counts(segs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seg, c): for each segment's words of a bucket, in hash order, the global training counts;
    rows without seg hold the bucket's distinct training words, counts and sums."""

    def split(batches):
        for batch in batches:
            for seg, vocab, counts in zip(*[c.to_pylist() for c in batch.columns]):
                vocab, counts = unzipped(vocab, np.uint64), unzipped(counts, np.uint32)
                # hashes ascend, so equal parts of the hash range are runs
                cut = np.searchsorted(vocab, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
                cut = np.concatenate([[0], cut, [len(vocab)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(buckets), pa.int32()), pa.array([seg] * buckets, pa.int64()),
                     pa.array([zipped(vocab[a:b]) for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([zipped(counts[a:b]) for a, b in zip(cut, cut[1:])], pa.binary())], ["bucket", "seg", "vocab", "counts"])

    def merge(key, rows):
        rows = rows.to_pylist()
        vocab = [unzipped(r["vocab"], np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(vocab), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate([unzipped(r["counts"], np.uint32) for r in rows]), minlength=len(words)).astype(np.int64)
        ends = np.cumsum([len(v) for v in vocab])
        known = c > 0
        out = [(key[0].as_py(), r["seg"], zipped(c[at[b - len(v):b]]), None, 0, 0) for r, v, b in zip(rows, vocab, ends)]
        out.append((key[0].as_py(), None, zipped(c[known]), zipped(words[known]), int(c.sum()), int(known.sum())))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))],
                        ["bucket", "seg", "c", "words", "total", "types"])

    parts = segs.select("seg", "vocab", "counts").mapInArrow(split, "bucket int, seg long, vocab binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(merge, "bucket int, seg long, c binary, words binary, total long, types long")


def frequent(counts: DataFrame, least: float) -> dict[int, int]:
    """Hash -> count of the words with at least ``least`` tokens: at most 1 / SYMBOL_SHARE words."""

    def run(batches):
        for batch in batches:
            for c, words in zip(*[x.to_pylist() for x in batch.columns]):
                c, words = unzipped(c, np.int64), unzipped(words, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(words[c >= least].view(np.int64)), pa.array(c[c >= least])], ["w", "c"])

    rows = counts.where("seg is null").select("c", "words").mapInArrow(run, "w long, c long").collect()
    return {int(np.int64(r["w"]).view(np.uint64)): r["c"] for r in rows}


class Symbols:
    """Symbol numbers from 1 by word hash; 0 stands for every other word."""

    def __init__(self, words: dict[int, int], total: int):
        self.hashes = np.sort(np.array(list(words), np.uint64))
        self.count = np.array([max(total - sum(words.values()), 0), *[words[int(h)] for h in self.hashes]], np.int64)

    def of(self, vocab: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(vocab), np.int64)
        at = np.searchsorted(self.hashes, vocab)
        return np.where(self.hashes[np.minimum(at, len(self.hashes) - 1)] == vocab, at + 1, 0).astype(np.int64)


def histories(symbols: np.ndarray, n: np.ndarray, depth: int, base: int) -> list[np.ndarray]:
    """For d = 1..depth the number of each token's last d symbols (oldest first), -1 across a document's start."""
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(n) - n, n)
    out, code = [], np.zeros(len(symbols), np.int64)
    for d in range(1, depth + 1):
        older = np.concatenate([np.zeros(d, np.int64), symbols[:-d]]) if len(symbols) > d else np.zeros(len(symbols), np.int64)
        code = code + older * np.int64(base) ** (d - 1)
        out.append(np.where(place >= d, code, -1))
    return out


def count_next(segs: DataFrame, symbols: Symbols, contexts: np.ndarray, depth: int) -> DataFrame:
    """(context, symbol, n) over the training documents for the given contexts of one depth."""
    shared = segs.sparkSession.sparkContext.broadcast((symbols, contexts))

    def run(batches):
        symbols, contexts = shared.value
        base = len(symbols.count)
        for batch in batches:
            for n, held, tokens, vocab in zip(*[c.to_pylist() for c in batch.columns]):
                n, held = np.frombuffer(n, np.int64), np.frombuffer(held, bool)
                s = symbols.of(unzipped(vocab, np.uint64))[unzipped(tokens, np.uint32)]
                code = histories(s, n, depth, base)[-1]
                at = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
                use = (contexts[at] == code) & np.repeat(~held, n)
                pair, count = np.unique(at[use] * np.int64(base) + s[use], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(contexts[pair // base]), pa.array(pair % base), pa.array(count)], ["ctx", "sym", "n"])

    rows = segs.select("n", "held", "tokens", "vocab").mapInArrow(run, "ctx long, sym long, n long")
    return rows.groupBy("ctx", "sym").agg(F.sum("n").alias("n"))


def checked_base(base: int) -> int:
    """A context and its next symbol are one signed 64-bit number; ``SYMBOL_SHARE`` keeps the symbols few enough for that."""
    if base ** (DEPTH + 1) > 2**63:
        raise ValueError(f"{base} symbols do not fit into contexts of {DEPTH}: raise SYMBOL_SHARE or lower DEPTH")
    return base


def grow_tree(segs: DataFrame, symbols: Symbols, total: int, types: int) -> list[dict]:
    """Per depth the retained contexts with their smoothed tables, sorted for look-up."""
    base = checked_base(len(symbols.count))
    # parent of depth 1: the base distribution over symbols (add-one, spread over unseen words in symbol 0)
    p0 = (symbols.count + np.where(np.arange(base) == 0, types + 1 - (base - 1), 1)) / (total + types + 1)
    tree: list[dict] = []
    least = max(CONTEXT_SHARE * total, 1)
    candidates = np.flatnonzero(symbols.count >= least).astype(np.int64)
    for depth in range(1, DEPTH + 1):
        if not len(candidates):
            break
        sums = stored(count_next(segs, symbols, np.sort(candidates), depth), f"next{depth}")
        whole = sums.groupBy("ctx").agg(F.sum("n").alias("all"))
        # bounded by (1 / CONTEXT_SHARE) contexts of (1 / NEXT_SHARE) symbols
        rows = sums.join(F.broadcast(whole), "ctx").where(F.col("n") >= NEXT_SHARE * F.col("all")).toArrow()
        if not rows.num_rows:
            break
        ctx, sym, n, all_ = (rows.column(c).to_numpy() for c in ("ctx", "sym", "n", "all"))
        order = np.lexsort((sym, ctx))
        ctx, sym, n, all_ = ctx[order], sym[order], n[order], all_[order]
        parent = lookup(tree, depth - 1, ctx % base ** (depth - 1), sym, p0, base)
        c, first = np.unique(ctx, return_index=True)
        seen, size = np.add.reduceat(n, first), all_[first]
        rest = 1 - seen / (size + MASS)
        p = n / (all_ + MASS) + np.repeat(rest, np.diff(np.append(first, len(n)))) * parent
        gain = np.add.reduceat(n * np.log((n / all_) / parent), first)
        keep = gain >= DIVERGENCE
        kept_rows = np.repeat(keep, np.diff(np.append(first, len(n))))
        tree.append({"ctx": c[keep], "rest": rest[keep], "key": (ctx * base + sym)[kept_rows], "p": p[kept_rows]})
        frequent_next = n >= least
        candidates = np.unique((ctx * base + sym)[frequent_next])
    return tree


def lookup(tree: list[dict], depth: int, ctx: np.ndarray, sym: np.ndarray, p0: np.ndarray, base: int) -> np.ndarray:
    """P(symbol | context of ``depth`` symbols), falling to shorter retained suffixes."""
    p = p0[sym]
    for d in range(1, min(depth, len(tree)) + 1):
        p = step(tree[d - 1], ctx % base**d, sym, p, base)
    return p


def step(node: dict, ctx: np.ndarray, sym: np.ndarray, parent: np.ndarray, base: int) -> np.ndarray:
    if not len(node["ctx"]):
        return parent
    at = np.minimum(np.searchsorted(node["ctx"], ctx), len(node["ctx"]) - 1)
    held = node["ctx"][at] == ctx
    p = np.where(held, node["rest"][at] * parent, parent)
    key = ctx * base + sym
    k = np.minimum(np.searchsorted(node["key"], key), len(node["key"]) - 1)
    return np.where(held & (node["key"][k] == key), node["p"][k], p)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    segs = stored(segments(docs), "segments")
    counts = stored(word_counts(segs, buckets or partitions(spark)), "counts")
    sums = counts.agg(F.sum("total"), F.sum("types")).first()
    total, types = sums[0] or 0, sums[1] or 0
    symbols = Symbols(frequent(counts, max(SYMBOL_SHARE * total, 1)) if total else {}, total)
    tree = grow_tree(segs, symbols, total, types)
    shared = spark.sparkContext.broadcast((symbols, tree))

    def one(key, seg, resp):
        symbols, tree = shared.value
        base = len(symbols.count)
        r = {k: v[0] for k, v in seg.to_pydict().items()}
        c = np.concatenate([unzipped(x, np.int64) for _, x in sorted(zip(resp.column("bucket").to_pylist(), resp.column("c").to_pylist()))])
        ids, n, held = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["held"], bool)
        tokens, vocab = unzipped(r["tokens"], np.uint32), unzipped(r["vocab"], np.uint64)
        sym_of = symbols.of(vocab)
        s, count = sym_of[tokens], c[tokens]
        doc = np.repeat(np.arange(len(ids)), n)
        p_word = (count + 1) / (total + types + 1)
        p0 = (symbols.count + np.where(np.arange(base) == 0, types + 1 - (base - 1), 1)) / (total + types + 1)
        p = p0[s]
        for node, ctx in zip(tree, histories(s, n, len(tree), base)):
            p = step(node, ctx, s, p, base)
        # a word that is no symbol of its own has its share of symbol 0
        p = np.where(s == 0, p * p_word / p0[0], p)
        return pa.table([pa.array([None if i == -2**63 else int(i) for i in ids], pa.int64()), pa.array(held), pa.array(n),
                         pa.array(np.bincount(doc, weights=count > 0, minlength=len(ids)).astype(np.int64)),
                         pa.array([total] * len(ids), pa.int64()), pa.array(np.bincount(doc, weights=np.log10(p_word), minlength=len(ids))),
                         pa.array(np.bincount(doc, weights=np.log10(p), minlength=len(ids)))],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = counts.where("seg is not null").select("bucket", "seg", "c")
    return segs.groupBy("seg").cogroup(answers.groupBy("seg")).applyInArrow(one, RESULT)


def op5(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_lm_scoring": (op5, None)}
