"""Alignment of two tokenizers over a corpus, with pair counts behind a minimal perfect hash.

First pass: every document is encoded twice; tokens of both sides whose byte ranges overlap are linked, and each task
counts, per pair of ids, its documents that hold the pair linked. Distinct pairs meet by hash bucket in a tree of unions. In
every bucket a minimal perfect hash is built level by level: pairs alone in their cell of a bit array are settled,
the rest go to the next level, and a pair's index is the number of set bits before its cell. Counts are then dense vectors in
index order, summed over tasks in a tree, with the pairs themselves beside them in the same order: a lookup is
right only if the pair found there is the pair asked for. Second pass: documents are aligned anew and their links
looked up. What the second pass needs is bounded by the vocabularies, not by the corpus, but that bound is wide; it is therefore
cut into tables of at most ``TABLE_PAIRS`` pairs, one broadcast and one pass each (one on the usual corpus).

Both encodings start anew at a space that a non-blank follows and no space precedes, so texts are cut there
and each distinct word is encoded, checked and aligned once per task. A text in which some word's bytes differ is encoded
and compared as a whole.

Defined cases: texts that are null, empty, or whose bytes differ on either side have no tokens (zeros, an empty
digest) and count for no pair; null doc_ids and repeated rows are documents of their own; an empty table gives an empty
result; a very long text is held by one task at a time; more columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import released, stored, table
from tickloom.llm.words import CACHE_BYTES, at_spaces, slices

#: hash buckets of pairs; their number follows from the vocabularies, which bound the pairs
BUCKETS = 256
FAN_IN = 32
TABLE_PAIRS = 4_000_000
#: pairs that a task holds before it merges them
MERGE_PAIRS = 4_000_000
#: bits per pair of a level
SPREAD = 2
GROUPS = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"


def tokenizer_paths() -> tuple[str, str]:
    """The first vocabulary as ranks: ids equal those of its tokenizers file without special tokens (tested), at a
    quarter of the time."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


# ---- the two tokenizers ------------------------------------------------------------------------

class Pair:
    """Both tokenizers, their ids' bytes, and alignments of words and texts."""

    def __init__(self, path_a: str, path_b: str, with_groups: bool = True):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.with_groups = with_groups
        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = {i: token for token, i in ranks.items()}
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.width = len(pieces)
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.sizes_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.sizes_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def aligned(self, texts: list[str]) -> tuple[list[str], Aligned]:
        """``texts``, whose first character is the space of the contract, in the order of their alignments.

        Words are encoded many at a time: joined, each still begins at its space on both sides.
        """
        words, others = [], []
        for t in texts:
            (words if WORD.fullmatch(t) else others).append(t)
        order, found = [], []
        for i in range(0, len(words), TOGETHER):
            run = words[i:i + TOGETHER]
            got = self.links(run)
            if got is None:
                others.extend(run)
            else:
                order.extend(run)
                found.append(got)
        for t in others:
            order.append(t)
            found.append(self.links([t]) or NOTHING)
        return order, Aligned(*map(np.concatenate, zip(*found)))

    def links(self, texts: list[str]) -> Aligned | None:
        """Alignments of the words of a run, or None where its bytes differ on either side."""
        text = "".join(texts)
        raw, a, b = text.encode(), self.a.encode_ordinary(text), self.b.encode(text[1:])
        if (b"".join(map(self.bytes_a.__getitem__, a)) != raw) or (b"".join(map(self.bytes_b.__getitem__, b)) != raw):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # every end on either side closes one link; ends of both close a group
        both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
        twice = both[1:] == both[:-1]
        ends, common = both[np.concatenate([~twice, [True]])], both[1:][twice]
        pairs = (a[np.searchsorted(ends_a, ends)] * self.width + b[np.searchsorted(ends_b, ends)]).astype(np.uint32)
        cut = np.cumsum([len(t.encode()) for t in texts])
        past = np.stack([np.searchsorted(x, cut, "right") for x in (ends_a, ends_b, common, ends)], 1)
        text, size = np.zeros(0, np.uint8), np.zeros(len(texts), np.int64)
        if self.with_groups:
            text, written = groups_text(a, b, ends_a, ends_b, common)
            size = np.diff(written[past[:, 0] + past[:, 1] - 1], prepend=0)
        return Aligned(np.ones(len(texts), bool), pairs, np.diff(past, axis=0, prepend=0), text, size)


class Aligned(NamedTuple):
    """Alignments of words, one after the other."""
    ok: np.ndarray  # per word: both sides hold its bytes
    pairs: np.ndarray  # codes of all links
    counts: np.ndarray  # per word: tokens of both sides, groups, links
    text: np.ndarray  # groups as characters, each with its mark
    size: np.ndarray  # per word: characters


NOTHING = Aligned(np.zeros(1, bool), np.zeros(0, np.uint32), np.zeros((1, 4), np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))


#: a space and a word that neither begins nor ends with a blank; words that are encoded together
WORD = re.compile(r" \S(?:.*\S)?", re.DOTALL)
TOGETHER = 400


def groups_text(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of both sides by groups, each with its mark, and the number of characters up to every id."""
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    past_a, past_b = np.searchsorted(ends_a, common, "right"), np.searchsorted(ends_b, common, "right")
    before_b = np.concatenate([[0], past_b[:-1]])
    at_a, at_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + past_a[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[past_a - 1]], mark[at_b[past_b - 1]] = ord("|"), ord(";")
    digits, size = decimals(ids)
    digits[np.arange(len(ids)), size] = mark
    text = digits[np.arange(digits.shape[1]) <= size[:, None]]
    written = np.cumsum(size + 1)
    return text, written


def decimals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of every id, left-aligned with room for one mark, and their number."""
    size = np.searchsorted(10 ** np.arange(1, 10), ids, "right") + 1
    digits = np.zeros((len(ids), int(size.max(initial=1)) + 1), np.uint8)
    for k in range(digits.shape[1] - 1):
        digits[:, k] = ids // 10 ** np.maximum(size - 1 - k, 0) % 10 + ord("0")
    return digits, size


class Column:
    """An array that grows by appending."""

    def __init__(self, kind, width: tuple = ()):
        self.data, self.n = np.empty((1024, *width), kind), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            wider = np.empty((max(self.n + len(x), 2 * len(self.data)), *self.data.shape[1:]), self.data.dtype)
            wider[:self.n] = self.data[:self.n]
            self.data = wider
        self.data[self.n:self.n + len(x)] = x
        self.n += len(x)


class Lists:
    """Lists of values by number."""

    def __init__(self, kind):
        self.values, self.start, self.size = Column(kind), Column(np.int64), Column(np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        self.start.add(self.values.n + np.cumsum(size) - size)
        self.size.add(size)
        self.values.add(values)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all these lists, size of each)"""
        size = self.size.data[numbers]
        shift = self.start.data[numbers] - (np.cumsum(size) - size)
        return self.values.data[np.repeat(shift, size) + np.arange(int(size.sum()))], size


class Aligner:
    """Alignments of texts by way of their words, each word's worked out once per task. ``more`` turns new alignments
    into columns that are kept beside their counts."""

    def __init__(self, paths: tuple[str, str], with_groups: bool, more=None):
        self.pair, self.more = Pair(*paths, with_groups), more
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ok, self.pairs, self.text = Column(bool), Lists(np.uint32), Lists(np.uint8)
        self.counts = Column(np.int64, (6 if self.more else 4,))

    def add(self, words: list[str]) -> list[str]:
        order, found = self.pair.aligned(words)
        self.ok.add(found.ok)
        self.pairs.add(found.pairs, found.counts[:, 3])
        self.text.add(found.text, found.size)
        self.counts.add(np.concatenate([found.counts, self.more(found)], 1) if self.more else found.counts)
        return order

    def texts(self, texts: list[str], distinct: bool) -> list[np.ndarray | None]:
        """Per text the numbers of its words (or distinct words); None without tokens."""
        if len(self.number) * 150 + self.pairs.values.n * 4 + self.text.values.n > CACHE_BYTES:
            self.clear()
        cut = [at_spaces(" " + t) for t in texts]
        # the first part is empty, or holds the leading blanks of a text
        words = [[" " + w for w in c[1:]] if not c[0] else [c[0], *(" " + w for w in c[1:])] for c in cut]
        words = [set(w) if distinct else w for w in words]
        missing = list(set().union(*(w for w, t in zip(words, texts) if t)) - self.number.keys())
        if missing:
            first = self.ok.n
            order = self.add(missing)
            self.number.update(zip(order, range(first, first + len(order))))
        out = []
        for t, w in zip(texts, words):
            numbers = np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)) if t else None
            if t and not self.ok.data[numbers].all():
                self.add([" " + t])  # as a whole
                numbers = np.array([self.ok.n - 1]) if self.ok.data[self.ok.n - 1] else None
            out.append(numbers)
        return out


# ---- minimal perfect hash ----------------------------------------------------------------------

def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) % np.uint64(BUCKETS)).astype(np.int32)


def perfect_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays, one per level: a key's cell is set in the first level where it is alone in it."""
    levels, left = [], keys
    while len(left):
        size = SPREAD * len(left) + 1
        cell = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(cell, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[cell]]
    return levels


def index_of(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Index of every key, 0 to n-1 over the keys hashed; some index or -1 for other keys."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for seed, bits in enumerate(levels):
        if not len(left):
            break
        cell = (mixed(keys[left], seed) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits)
        hit = bits[cell]
        out[left[hit]] = before + rank[cell[hit]] - 1
        before, left = before + int(rank[-1]), left[~hit]
    return out


def packed(levels: list[np.ndarray]) -> tuple[list[int], list[bytes]]:
    return [len(b) for b in levels], [np.packbits(b).tobytes() for b in levels]


def unpacked(sizes: list[int], bits: list[bytes]) -> list[np.ndarray]:
    return [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for n, b in zip(sizes, bits)]


# ---- first pass: counts ------------------------------------------------------------------------

def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts), minlength=len(found)).astype(np.int64)


def distinct_pairs(aligner: Aligner, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, number of documents that hold them) of documents given as numbers of their words."""
    codes, size = aligner.pairs.of(np.concatenate(documents))
    of_document = np.repeat(np.arange(len(documents), dtype=np.uint64), [len(d) for d in documents])
    once = np.unique(np.repeat(of_document, size) << np.uint64(32) | codes.astype(np.uint64))
    return np.unique((once & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)


def task_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(bucket, task, pairs, counts): one row per task and bucket; pairs ascend."""
    def run(batches):
        from pyspark import TaskContext

        aligner = Aligner(paths, with_groups=False)
        keys, counts, held = [], [], 0
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for i, j in slices(texts):
                got = [numbers for numbers in aligner.texts(texts[i:j], distinct=True) if numbers is not None]
                if not got:
                    continue
                k, n = distinct_pairs(aligner, got)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 2 * MERGE_PAIRS:
                    k, n = merged(keys, counts)
                    keys, counts, held = [k], [n], 0
        if not keys:
            return
        k, n = merged(keys, counts)
        bucket = bucket_of(k)
        order = np.argsort(bucket, kind="stable")
        k, n, cut = k[order], n[order], np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        used = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), TaskContext.get().partitionId(), np.int32)),
             pa.array([k[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary()),
             pa.array([n[cut[b]:cut[b + 1]].tobytes() for b in used], pa.binary())], ["bucket", "task", "pairs", "counts"])

    return docs.select("text").mapInArrow(run, "bucket int, task int, pairs binary, counts binary")


def tree(rows: DataFrame, n_tasks: int, merge, schema: str) -> DataFrame:
    """One row per bucket: ``merge`` is applied to ``FAN_IN`` rows of a bucket at a time, level by level."""
    while True:
        rows = (rows.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int"))
                .groupBy("bucket", "task").applyInArrow(merge, schema))
        n_tasks = -(-n_tasks // FAN_IN)
        if n_tasks <= 1:
            return rows


def from_column(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def unions(rows: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(from_column(rows.column("pairs"), np.uint32)))
    return pa.table({"bucket": rows.column("bucket")[:1], "task": rows.column("task")[:1], "pairs": pa.array([keys.tobytes()], pa.binary())})


HASH_DDL = "bucket int, n long, sizes array<int>, bits array<binary>, pairs binary"


def hashes(batches):
    """A bucket's perfect hash, and its pairs in index order."""
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = np.frombuffer(raw, np.uint32)
            levels = perfect_hash(keys)
            at = np.empty_like(keys)
            at[index_of(keys, levels)] = keys
            sizes, bits = packed(levels)
            yield pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([sizes], pa.list_(pa.int32())),
                 pa.array([bits], pa.list_(pa.binary())), pa.array([at.tobytes()], pa.binary())], ["bucket", "n", "sizes", "bits", "pairs"])


def dense(batches):
    """A task's counts of a bucket as a dense vector in index order."""
    for batch in batches:
        cols = {f: batch.column(f).to_pylist() for f in ("bucket", "task", "pairs", "counts", "n", "sizes", "bits")}
        vectors = []
        for pairs, counts, n, sizes, bits in zip(*(cols[c] for c in ("pairs", "counts", "n", "sizes", "bits"))):
            vector = np.zeros(n, np.int64)
            vector[index_of(np.frombuffer(pairs, np.uint32), unpacked(sizes, bits))] = np.frombuffer(counts, np.int64)
            vectors.append(vector.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("task"), pa.array(vectors, pa.binary())],
                                         ["bucket", "task", "vector"])


def vector_sums(rows: pa.Table) -> pa.Table:
    total = reduce(np.add, from_column(rows.column("vector"), np.int64))
    return pa.table({"bucket": rows.column("bucket")[:1], "task": rows.column("task")[:1], "vector": pa.array([total.tobytes()], pa.binary())})


def pair_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(bucket, n, sizes, bits, pairs, vector): per bucket its perfect hash, and pairs and document counts in index order."""
    counts = stored(task_counts(docs, paths), "pair-counts")
    n_tasks = (counts.agg(F.max("task")).first()[0] or 0) + 1
    distinct = tree(counts.select("bucket", "task", "pairs"), n_tasks, unions, "bucket int, task int, pairs binary")
    hashed = stored(distinct.select("bucket", "pairs").mapInArrow(hashes, HASH_DDL), "pair-hash")
    vectors = counts.join(hashed.drop("pairs"), "bucket").mapInArrow(dense, "bucket int, task int, vector binary")
    summed = tree(vectors, n_tasks, vector_sums, "bucket int, task int, vector binary")
    out = stored(hashed.join(summed.drop("task"), "bucket"), "pair-table")
    released(docs.sparkSession, counts, hashed)
    return out


# ---- second pass: lookups ----------------------------------------------------------------------

def highest(table_: DataFrame, width: int) -> dict[int, int]:
    """The highest count of every id of the first tokenizer: at most its vocabulary."""
    def run(batches):
        for batch in batches:
            for pairs, vector in zip(from_column(batch.column(0), np.uint32), from_column(batch.column(1), np.int64)):
                a, at = np.unique(pairs // np.uint32(width), return_inverse=True)
                top = np.zeros(len(a), np.int64)
                np.maximum.at(top, at, vector)
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(top)], ["a", "top"])

    rows = table_.select("pairs", "vector").mapInArrow(run, "a long, top long").groupBy("a").agg(F.max("top").alias("top"))
    return {r.a: r.top for r in rows.collect()}


class Lookup:
    """Counts of pairs from some buckets of the pair table; 0 for pairs of other buckets and for unknown pairs."""

    def __init__(self, rows):
        rows = sorted(rows, key=lambda r: r["bucket"])
        self.of = {r["bucket"]: i for i, r in enumerate(rows)}
        self.levels = [unpacked(r["sizes"], r["bits"]) for r in rows]
        self.pairs = [np.frombuffer(r["pairs"], np.uint32) for r in rows]
        self.counts = [np.frombuffer(r["vector"], np.int64) for r in rows]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, bucket = np.zeros(len(keys), np.int64), bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        for b in np.flatnonzero(np.diff(cut)):
            i = self.of.get(int(b))
            if i is None:
                continue
            here = order[cut[b]:cut[b + 1]]
            at = index_of(keys[here], self.levels[i])
            # another pair stands there if this one was never counted: it is held by texts without tokens only
            out[here] = np.where(self.pairs[i][at] == keys[here], self.counts[i][at], 0)
        return out


def looked_up(docs: DataFrame, paths: tuple[str, str], rows: list, tops: np.ndarray, width: int) -> DataFrame:
    """Adds what the given part of the pair table knows to n_best and count_sum."""
    shared = docs.sparkSession.sparkContext.broadcast((rows, tops))  # at most TABLE_PAIRS pairs and one vocabulary

    def run(batches):
        rows, tops = shared.value
        lookup = Lookup(rows)

        def more(found: Aligned) -> np.ndarray:
            """n_best and count_sum of every word."""
            distinct, back = np.unique(found.pairs, return_inverse=True)
            counts = lookup(distinct)
            best = ((counts == tops[distinct // np.uint32(width)]) & (counts > 0))[back]
            past = np.cumsum(found.counts[:, 3])
            total = np.concatenate([[[0, 0]], np.cumsum(np.stack([best.astype(np.int64), counts[back]], 1), 0)])
            return np.diff(total[past], axis=0, prepend=0)

        aligner = Aligner(paths, True, more)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            groups, numbers = [""] * len(texts), np.zeros((len(texts), 6), np.int64)
            for i, j in slices(texts):
                found = [(k, v) for k, v in enumerate(aligner.texts(texts[i:j], distinct=False), i) if v is not None]
                if not found:
                    continue
                words = np.concatenate([v for _, v in found])
                last = np.cumsum([len(v) for _, v in found])
                first = last - [len(v) for _, v in found]
                numbers[[k for k, _ in found]] = np.add.reduceat(aligner.counts.data[words], first, axis=0)
                text, size = aligner.text.of(words)
                stop = np.cumsum(size)[last - 1]
                for (k, _), a, b in zip(found, [0, *stop[:-1]], stop):
                    groups[k] = hashlib.sha256(text[a:b - 1].tobytes()).hexdigest()
            numbers[:, 4] += np.asarray(batch.column(2))
            numbers[:, 5] += np.asarray(batch.column(3))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), pa.array(numbers[:, 4]), pa.array(numbers[:, 5]), *(pa.array(numbers[:, c]) for c in range(4)),
                 pa.array(groups)], ["doc_id", "text", "n_best", "count_sum", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])

    schema = "doc_id long, text string, n_best long, count_sum long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return docs.select("doc_id", "text", "n_best", "count_sum").mapInArrow(run, schema)


def vocabulary(paths: tuple[str, str]) -> tuple[int, int]:
    pair = Pair(*paths)
    return max(pair.bytes_a) + 1, pair.width


def parts_of(table_: DataFrame, limit: int) -> list[list[int]]:
    """Buckets in groups of at most ``limit`` pairs (one bucket at least)."""
    out, held = [[]], 0
    for r in table_.select("bucket", "n").orderBy("bucket").collect():  # at most BUCKETS rows
        if out[-1] and held + r.n > limit:
            out.append([])
            held = 0
        out[-1].append(r.bucket)
        held += r.n
    return out


def align(docs: DataFrame, paths: tuple[str, str] | None = None, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """Per document: token, group and link counts, n_best, count_sum and the digest of its groups."""
    paths = paths or tokenizer_paths()
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    counts = pair_counts(docs, paths)
    size_a, width = vocabulary(paths)
    tops = np.zeros(size_a, np.int64)
    for a, top in highest(counts, width).items():
        tops[a] = top
    out = docs.selectExpr("*", "0L as n_best", "0L as count_sum")
    before = None
    parts = parts_of(counts, table_pairs)
    for i, part in enumerate(parts):
        rows = [r.asDict() for r in counts.where(F.col("bucket").isin(part)).collect()]  # at most ``table_pairs`` pairs
        out = looked_up(out, paths, rows, tops, width)
        if i + 1 < len(parts):
            out = stored(out, "aligned")
            if before is not None:
                released(docs.sparkSession, before)
            before = out
    return out.drop("text")


def pair_table(spark: SparkSession, counts: DataFrame, width: int) -> DataFrame:
    """(a, b, n_docs) of every distinct linked pair, from what ``pair_counts`` returns."""
    def run(batches):
        for batch in batches:
            for pairs, vector in zip(from_column(batch.column(0), np.uint32), from_column(batch.column(1), np.int64)):
                a, b = np.divmod(pairs.astype(np.int64), width)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(vector)], ["a", "b", "n_docs"])

    return counts.select("pairs", "vector").mapInArrow(run, "a long, b long, n_docs long")


def op13(spark, sf_dir):
    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *GROUPS, "groups_sha256")


QUERIES = {"op13_tokenizer_alignment": (op13, None)}
