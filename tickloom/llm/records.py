"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A file is a run of frames: length (unsigned 64-bit), masked CRC-32C of those eight bytes, payload, masked CRC-32C
of the payload, all little-endian. A payload is a flag (lowest bit: the document has an id), the width of an id in bytes,
the doc_id and the token ids as unsigned integers of 16 bits where the vocabulary allows, else of 32. After every block of frames stands a frame without payload; readers pass over it.
Texts are range-partitioned and sorted by doc_id, encoded in Arrow batches inside their partition, and
written by Spark's own writer, whose commit leaves exactly one copy of every file when executors are lost. The text
writer puts out raw bytes and ends each row with a separator: that separator is the empty frame, so
every file holds nothing but valid frames. The index is a Parquet table of (part, record, offset, size, doc_id, n_tokens).

Defined cases: null or empty text is the end id alone; null doc_id comes last and reads back as null; rows with equal
doc_id follow their text's hash, equal rows stand side by side; an empty table gives no records; a very long text is one
record, and the longest record plus ``file_bytes`` bounds a reader's memory; more columns are ignored.
A frame that is cut short or fails a checksum raises ``ValueError``.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import partitions, shared_dir, shipped, table
from tickloom.llm.words import WordCache, slices

END_ID = 1
FILE_BYTES, BLOCK_BYTES = 16 << 20, 4 << 20
HEAD, HEAD_BYTES = "<HHq", 12
MASK = 0xA282EAD8
#: CRC-32C (Castagnoli), reflected
POLYNOMIAL = 0x82F63B78
CHUNK = 256
INDEX = "part int, record long, offset long, size long, doc_id long, n_tokens long"


# ---- checksums ---------------------------------------------------------------------------------

def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


def _apply(op: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit registers, given as four tables of 256."""
    return op[0][x & 255] ^ op[1][(x >> 8) & 255] ^ op[2][(x >> 16) & 255] ^ op[3][x >> 24]


def _tables():
    byte = _byte_table()
    column = np.arange(256, dtype=np.uint32)
    values = [column << np.uint32(8 * i) for i in range(4)]
    shift = np.stack([byte[v & 255] ^ (v >> 8) for v in values])  # past one zero byte
    shifts = [shift]
    for _ in range(40):  # past 2, 4, 8 ... bytes
        shifts.append(np.stack([_apply(shifts[-1], _apply(shifts[-1], v)) for v in values]))
    return shifts


_SHIFTS: list = []


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of each span of ``data``. Spans are cut into chunks that all advance together, and chunks are joined
    by shifting registers past zero bytes; zeros in front of a span leave an empty register empty."""
    if not _SHIFTS:
        _SHIFTS.extend(_tables())
    size = (ends - starts).astype(np.int64)
    n_chunks = -(-size // CHUNK)
    past = np.cumsum(n_chunks)
    lanes = np.zeros(int(past[-1]) * CHUNK if len(past) else 0, np.uint8)
    for s, e, p in zip(starts, ends, past * CHUNK):
        lanes[p - (e - s):p] = data[s:e]
    words = np.ascontiguousarray(lanes.view("<u4").reshape(-1, CHUNK // 4).T)
    register = np.zeros(words.shape[1], np.uint32)
    for w in words:
        register = _apply(_SHIFTS[2], register ^ w)
    out = np.zeros(len(size), np.uint32)
    chunk = _SHIFTS[CHUNK.bit_length() - 1]
    for j in range(int(n_chunks.max(initial=0))):
        live = np.flatnonzero(n_chunks > j)
        out[live] = _apply(chunk, out[live]) ^ register[past[live] - n_chunks[live] + j]
    lead = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k in range(int(size.max(initial=0)).bit_length()):
        lead = np.where(size >> k & 1, _apply(_SHIFTS[k], lead), lead)
    return out ^ lead ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def span_checksums(chunks: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(c) for c in chunks])
    return masked(crc32c(np.frombuffer(b"".join(chunks), np.uint8), ends - [len(c) for c in chunks], ends))


def frames(payloads: list[bytes]) -> bytes:
    if not payloads:
        return b""
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return b"".join(x for n, a, p, b in zip(lengths, span_checksums(lengths), payloads, span_checksums(payloads))
                    for x in (n, struct.pack("<I", a), p, struct.pack("<I", b)))


def payload_spans(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of every payload of a file, empty frames included; raises where the file is damaged."""
    at, starts, ends = 0, [], []
    while at < len(content):
        if at + 12 > len(content):
            raise ValueError(f"record header cut short at byte {at}")
        n = int.from_bytes(content[at:at + 8], "little")
        if at + 16 + n > len(content):
            raise ValueError(f"record cut short at byte {at}")
        starts.append(at + 12)
        ends.append(at + 12 + n)
        at += 16 + n
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    data = np.frombuffer(content, np.uint8)
    for a, b in ((starts - 12, starts - 4), (starts, ends)):
        stored = np.array([int.from_bytes(content[e:e + 4], "little") for e in b], np.uint32)
        wrong = np.flatnonzero(masked(crc32c(data, a, b)) != stored)
        if len(wrong):
            raise ValueError(f"checksum differs in the record at byte {int(starts[wrong[0]]) - 12}")
    return starts, ends


# ---- encoding ----------------------------------------------------------------------------------

def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: pipeline of a tokenizer whose pieces of simple texts a plain pattern finds; fixed values of its file
PIPELINE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: simple characters: ASCII and the letters of Latin-1, without the controls that only Python takes for blanks. Composition
#: leaves them as they are, and they are letters, digits, blanks or neither by every version of Unicode
SIMPLE = re.compile("[\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
PIECES = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: pieces that are encoded in one string
TOGETHER = 200
#: characters at which Python splits but the tokenizer does not
PYTHON_BLANK = re.compile("[\x1c-\x1f]")


def id_kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


class TextIds:
    """Ids of texts. With the known pipeline, each distinct piece of simple words is encoded once per task;
    texts that hold an added token, and all texts of any other pipeline, are encoded whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.known = all(parts[k] == v for k, v in PIPELINE.items())
        added = [t["content"] for t in parts["added_tokens"]]
        self.known &= not any(re.search(r"\s", t) for t in added)
        self.added = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        # the same merges over pieces that are set apart by spaces
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.kind = id_kind(max(vocabulary.values()) + 1)
        suffix = parts["model"].get("end_of_word_suffix")
        self.known &= bool(suffix)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.cache = WordCache(self.of_pieces)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_pieces(self, pieces: list[str]) -> list[bytes]:
        runs = [pieces[i:i + TOGETHER] for i in range(0, len(pieces), TOGETHER)]
        out = []
        for run, e in zip(runs, self.pieces.encode_batch_fast([" ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(ends) != len(run):
                raise ValueError("a piece does not end with the tokenizer's mark of word ends")
            raw, width = ids.tobytes(), ids.itemsize
            out.extend(raw[a * width:b * width] for a, b in zip([0, *ends], ends))
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        by_piece = [self.known and SIMPLE.fullmatch(t) is not None and not self.added.search(t) for t in texts]
        pieces = [PIECES.findall(t.lower()) if p else [] for t, p in zip(texts, by_piece)]
        get = self.cache.ensure(set().union(*pieces))
        return [b"".join(map(get, w)) if p else self.mixed(t) for t, w, p in zip(texts, pieces, by_piece)]

    def mixed(self, text: str) -> bytes:
        """Ids of a text that is not simple: its simple words by their pieces, the others whole."""
        if not self.known or self.added.search(text) or PYTHON_BLANK.search(text):
            return self.whole([text])[0]
        words = text.split()
        simple = [SIMPLE.fullmatch(w) is not None for w in words]
        pieces = [PIECES.findall(w.lower()) if s else [] for w, s in zip(words, simple)]
        get = self.cache.ensure({p for ps in pieces for p in ps})
        others = iter(self.whole([w for w, s in zip(words, simple) if not s]))
        return b"".join(b"".join(map(get, p)) if s else next(others) for p, s in zip(pieces, simple))


@functools.lru_cache(maxsize=1)
def text_ids(path: str) -> TextIds:
    """One encoder per Python worker: its vocabulary and cache outlive a task and never stand there twice."""
    return TextIds(path)


# ---- files -------------------------------------------------------------------------------------

def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                  file_bytes: int = FILE_BYTES) -> None:
    """Write ``docs`` (doc_id, text) under ``path``/data in ascending doc_id order and its index under ``path``/index."""
    spark = docs.sparkSession
    shipped(spark)
    tokenizer = tokenizer or tokenizer_path()
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "coalesce(cast(text as string), '') as text")
    # ids take no more bytes than the text, so the files' number follows from a sum over the texts
    total = rows.agg(F.sum(F.octet_length("text").cast("long") + 16)).first()[0] or 0
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), "tie"]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(max(partitions(spark), -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def run(batches):
        encoder = text_ids(tokenizer)
        end, width = np.array([end_id], encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        block, size = [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in slices(texts):
                for doc_id, tokens in zip(ids[i:j], encoder.texts(texts[i:j])):
                    block.append(struct.pack(HEAD, doc_id is not None, width, doc_id or 0) + tokens + end)
                    size += len(block[-1])
                    if size >= BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([frames(block)], pa.binary())], ["value"])
                        block, size = [], 0
        if block:
            yield pa.RecordBatch.from_arrays([pa.array([frames(block)], pa.binary())], ["value"])

    out = dealt.select("doc_id", "text").mapInArrow(run, "value binary").selectExpr("cast(value as string) as value")
    # every byte of the empty frame as the character of that number
    out.write.option("lineSep", frames([b""]).decode("latin-1")).option("encoding", "ISO-8859-1").text(f"{path}/data")
    scan_records(spark, path, with_ids=False).select(*[c.split()[0] for c in INDEX.split(", ")]).write.parquet(f"{path}/index")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(part, content): one row per file; parts ascend as doc_ids do."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
            .select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int").alias("part"), "content"))


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def decoded(part: int, content: bytes, spans, with_ids: bool = True) -> dict:
    """Columns of the records at ``spans``; the ids are null on request."""
    out = {c: [] for c in ("part", "record", "offset", "size", "doc_id", "n_tokens", "before", "ids")}
    record = before = 0
    for s, e in spans:
        if s == e:
            continue
        known, width, doc_id = struct.unpack_from(HEAD, content, s)
        n = (e - s - HEAD_BYTES) // width
        ids = np.frombuffer(content, f"<u{width}", n, s + HEAD_BYTES).astype("<u4").tobytes() if with_ids else None
        for c, v in zip(out, (part, record, s - 12, e - s + 16, doc_id if known else None, n, before, ids)):
            out[c].append(v)
        record += 1
        before += n
    return out


SCAN = pa.schema([("part", pa.int32()), ("record", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()),
                  ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("ids", pa.binary())])
SCAN_DDL = f"{INDEX}, before long, ids binary"


def in_batches(cols: dict, rows: int = 2000):
    for i in range(0, len(cols["part"]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(cols[f.name][i:i + rows], f.type) for f in SCAN], schema=SCAN)


def scan_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every record in file order, ids widened to 32 bits (or left out), checksums verified; ``before``: ids of the records before it in its file."""
    def run(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                yield from in_batches(decoded(part, data, zip(*(x.tolist() for x in payload_spans(data))), with_ids))

    return files(spark, path).mapInArrow(run, SCAN_DDL)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every document with ``start``, the ids of all documents before it, and its ``ids``."""
    totals = index(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    # one row per file, bounded by their number whatever the documents
    return (scan_records(spark, path).join(F.broadcast(base), "part")
            .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids", "part", "record"))


def read_shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """All records in a random order that ``seed`` fixes: files in random order, records permuted inside each file.

    The index gives each file its offsets in the order of a seeded hash; the reader goes from offset to
    offset without scanning for frames. ``place`` numbers the result within a file's turn.
    """
    by_file = (index(spark, path).withColumn("turn", F.xxhash64("part", "record", F.lit(seed)))
               .groupBy("part").agg(F.sort_array(F.collect_list(F.struct("turn", "record", "offset", "size"))).alias("at")))

    def run(batches):
        for batch in batches:
            for part, content, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = content.as_py()
                picked = decoded(part, data, [(a["offset"] + 12, a["offset"] + a["size"] - 4) for a in at])
                picked["before"], picked["record"] = picked["record"], [a["record"] for a in at]
                yield from in_batches(picked)

    dealt = files(spark, path).join(by_file, "part").orderBy(F.xxhash64("part", F.lit(seed)))
    return (dealt.select("part", "content", "at").mapInArrow(run, SCAN_DDL)
            .select("doc_id", "n_tokens", "ids", "part", "record", F.col("before").alias("place")))


def op12(spark, sf_dir):
    path = shared_dir(spark, "records")
    write_records(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op12_binary_records": (op12, None)}
