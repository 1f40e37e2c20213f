"""Packing of documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at
most ``piece`` ids. Pieces of a group are divided among m windows by the differencing method:
every piece starts as a partial partition (its length and m-1 zeros); the two partial
partitions with the largest spread are merged, the largest load of one against the smallest of
the other, until one is left. m starts at the least possible count and rises while a window is over
capacity. Groups are formed inside input partitions, so nothing is shuffled or collected and a lost
task repeats with the same result.

Defined cases: null or empty text is the end id alone; null doc_id is kept; repeated rows are packed
once each; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import table

CAPACITY, PIECE, GROUP, END_ID = 1024, 256, 100, 0
#: a group closes when its last window would be nearly full; this leaves differencing some room
SLACK = (0.02, 0.15)
CACHE_WORDS = 500_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The vocabulary as ranks; with the added tokens of its tokenizers file the ids equal that file's (tested)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def added_tokens(path: str) -> dict[str, int]:
    """Tokens of a tokenizers file that are matched as whole strings before a text is cut into words."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", [])
    loose = [t["content"] for t in tokens if t["lstrip"] or t["rstrip"] or t["single_word"]]
    if loose:
        raise ValueError(f"{path}: added tokens {loose} take in blanks or need word borders")
    return {t["content"]: t["id"] for t in tokens}


#: a space before a blank or at the end stays with what precedes it
LOOSE = re.compile(r" (?=\s|\Z)")


class WordEncoder:
    """Ids of whole texts, word by word, with a cache of words.

    The tokenizer starts a new piece at every space that a non-blank follows, so a text may be cut
    there and every word be encoded by itself. A full cache keeps what it has. ``added`` tokens are taken
    as whole strings, leftmost and longest first; what lies between two of them is a text of its own.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced: dict[str, bytes] = {}
        self.added = {t: struct.pack("<I", i) for t, i in (added or {}).items()}
        self.borders = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")

    def word(self, word: str) -> bytes:
        ids = self.encoding.encode_ordinary(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.added and self.borders.search(text):
            return b"".join(self.added[p] if i % 2 else self.between(p) for i, p in enumerate(self.borders.split(text)))
        return self.between(text)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if LOOSE.search(text):
            parts = joined_loose(text)
        else:
            parts = text.split(" ")
        cache, out = self.spaced, [self.word(parts[0])]
        for p in parts[1:]:
            got = cache.get(p)
            if got is None:
                got = self.word(" " + p)
                if len(cache) < CACHE_WORDS:
                    cache[p] = got
            out.append(got)
        return b"".join(out)


def joined_loose(text: str) -> list[str]:
    """Parts between the spaces that a non-blank follows."""
    out: list[str] = []
    for p in text.split(" "):
        if out and (not p or p[0].isspace()):
            out[-1] += " " + p
        else:
            out.append(p)
    return out


def difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Karmarkar-Karp: indexes of ``sizes`` in ``bins`` groups of near-equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        loads = [(0, ())] * (bins - 1) + [(s, (i,))]
        heap.append((-s, i, loads))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # both ascend by load; opposing ends are merged. Members form a tree that is unrolled at the end
        merged = [(x[0] + y[0], (x[1], y[1]) if x[1] and y[1] else x[1] or y[1]) for x, y in zip(a, reversed(b))]
        merged.sort(key=lambda t: t[0])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], serial, merged))
        serial += 1
    return [unrolled(m) for _, m in heap[0][2]] if heap else []


def unrolled(tree) -> list[int]:
    out, stack = [], [tree]
    while stack:
        t = stack.pop()
        if isinstance(t, int):
            out.append(t)
        else:
            stack.extend(t)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    bins = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, bins)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        bins += 1


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE,
         group: int = GROUP, added: dict[str, int] | None = None) -> DataFrame:
    """One row per piece with its ids; windows are numbered by (input partition, count).

    ``path`` names ranks, ``added`` the tokens matched as whole strings (by default those of the default vocabulary).
    """
    if path is None:
        path, added = tokenizer_path(), added_tokens(tokenizer_path("byte_bpe_50k.json")) if added is None else added
    piece = min(piece, capacity)

    def run(batches):
        from pyspark import TaskContext

        encoder = WordEncoder(path, added)
        base, serial, pending = TaskContext.get().partitionId() << 32, 0, []

        def emit(rows, at):
            cols = list(zip(*rows))
            crc = [zlib.crc32(r[4]) for r in rows]
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                      pa.array(crc, pa.int64()), pa.array(cols[3], pa.int64()), pa.array([s for s, _ in at], pa.int64()),
                      pa.array([o for _, o in at], pa.int64()), pa.array(cols[4], pa.binary())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names)

        def flush():
            nonlocal serial, pending
            at = [None] * len(pending)
            for g in windows_of([p[2] for p in pending], capacity):
                offset = 0
                for i in sorted(g):
                    at[i] = (base + serial, offset)
                    offset += pending[i][2]
                serial += 1
            rows, pending = pending, []
            return emit(rows, at)

        for batch in batches:
            full, full_at = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + struct.pack("<I", END_ID)
                n = len(ids) // 4
                start = 0
                while n - start >= capacity:
                    full.append((doc_id, start, capacity, n, ids[4 * start:4 * (start + capacity)]))
                    full_at.append((base + serial, 0))
                    serial += 1
                    start += capacity
                    if len(full) >= 1000:
                        yield emit(full, full_at)
                        full, full_at = [], []
                while start < n:
                    k = min(piece, n - start)
                    pending.append((doc_id, start, k, n, ids[4 * start:4 * (start + k)]))
                    start += k
                slack = -sum(p[2] for p in pending) % capacity / capacity if len(pending) >= group else 1
                if SLACK[0] <= slack <= SLACK[1] or len(pending) >= 3 * group:
                    yield flush()
            if full:
                yield emit(full, full_at)
        if pending:
            yield flush()

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    return rows.mapInArrow(run, SCHEMA)


def op2(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")


QUERIES = {"op2_packing": (op2, None)}
