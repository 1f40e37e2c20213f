"""Records, vector codes and tokenizer alignment against brute force, on edge cases and in round trips."""

import hashlib
import math
import os
import random
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tickloom.llm import alignment, records, vector_codes  # noqa: E402
from tickloom.llm.common import shared_dir  # noqa: E402
from tickloom.llm.words import at_spaces  # noqa: E402

ODD = list("abzAB019 '.,$\n\t\r\x0b\x00\x7f\x1c\x1f\x85\xa0") + [
    "'s", "'LL", "ß", "É", "ÿ", "×", "²", "é", "İ", "K", "ς", "Σ", "日本", "😀", " ", "　", "▁", "<s>", "<0x41>",
    "<|endoftext|>", "<|startoftext|>", "<|", " the", " of ", "  ", "   ", "ﬁ", "́", " ́", "''", "don't", "word"]


def odd_texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = odd_texts(300, 25, 3) + ["plain words and more plain words"] * 4 + ["x" * 2000, "long text of words " * 60_000, "9" * 300]
    rows = [(7 * i % 311, t, i, "p") for i, t in enumerate(texts)] + [(None, None, 0, None), (None, "no id", 1, None), (5, "", 2, "q"), (5, "", 2, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, value string").repartition(4)


# ---- records -----------------------------------------------------------------------------------

def test_crc32c():
    data = b"123456789" + bytes(32) + bytes(range(256)) * 5
    got = records.crc32c(np.frombuffer(data, np.uint8), np.array([0, 9, 9]), np.array([9, 41, 9])).tolist()
    assert got == [0xE3069283, 0x8A9136AA, 0]  # published check values
    table, c = records._byte_table().tolist(), 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 255] ^ c >> 8
    assert records.crc32c(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0] == c ^ 0xFFFFFFFF


def test_text_ids_equal_tokenizer():
    ids = records.TextIds(records.tokenizer_path())
    texts = odd_texts(20000, 25, 1) + ["", "word " * 300_000, "y" * 3000]
    assert ids.known
    assert ids.texts(texts) == [np.array(e.ids, "<u2").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    ids.known = False
    assert ids.texts(texts[:2000]) == ids.whole(texts[:2000])


def test_records(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(records.tokenizer_path())
    path = shared_dir(spark, "test-records")
    records.write_records(docs, path, file_bytes=100_000)
    rows = sorted(((math.inf if r.doc_id is None else r.doc_id), r.text or "") for r in docs.collect())
    want = Counter()
    for did, t in rows:
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [1]
        want[did, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    got = sorted((r.start, math.inf if r.doc_id is None else r.doc_id, r.n_tokens, zlib.crc32(r.ids))
                 for r in records.read_records(spark, path).collect())
    assert Counter(r[1:] for r in got) == want
    assert [r[1] for r in got] == [did for did, _ in rows]
    start = 0
    for r in got:
        assert r[0] == start
        start += r[2]
    # seeded order: complete, repeatable, not the order of the files
    shuffled = [[(r.part, r.record, r.doc_id, bytes(r.ids)) for r in records.read_shuffled(spark, path, seed).collect()] for seed in (1, 1, 2)]
    plain = [(r.part, r.record, r.doc_id, bytes(r.ids)) for r in records.read_records(spark, path).collect()]
    assert shuffled[0] == shuffled[1] != shuffled[2]
    assert sorted(shuffled[0], key=str) == sorted(shuffled[2], key=str) == sorted(plain, key=str) and shuffled[0] != plain
    index = {(r.part, r.record): r for r in records.index(spark, path).collect()}
    for part, content in records.files(spark, path).collect():
        for (_, record), r in (x for x in index.items() if x[0][0] == part):
            frame = bytes(content[r.offset:r.offset + r["size"]])
            assert struct.unpack_from("<Q", frame)[0] == len(frame) - 16 == 12 + 2 * r.n_tokens


def test_one_encoder_per_worker_whatever_the_tasks(spark):
    path = records.tokenizer_path()

    def run(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([id(records.text_ids(path))])], ["worker", "encoder"])

    seen = spark.range(0, 12, 1, 12).mapInArrow(run, "worker long, encoder long").collect()
    assert len(seen) == 12 and len({tuple(r) for r in seen}) == len({r.worker for r in seen}) <= 4


def test_damaged_records(spark):
    whole = records.frames([b"abcdef", b"", b"xyz"])
    starts, ends = records.payload_spans(whole)
    assert [whole[s:e] for s, e in zip(starts, ends)] == [b"abcdef", b"", b"xyz"]
    for i in (0, 9, 14, len(whole) - 1):
        with pytest.raises(ValueError):
            records.payload_spans(whole[:i] + bytes([whole[i] ^ 1]) + whole[i + 1:])
    for n in (5, 30, len(whole) - 1):
        with pytest.raises(ValueError):
            records.payload_spans(whole[:n])
    assert records.payload_spans(b"")[0].size == 0


def test_empty_records(spark, docs):
    path = shared_dir(spark, "test-records")
    records.write_records(docs.where("false"), path)
    assert records.read_records(spark, path).count() == 0 == records.read_shuffled(spark, path, 3).count()


# ---- vector codes ------------------------------------------------------------------------------

def lloyd(rows, parts=4, entries=256, rounds=4):
    """Every round in full, in plain integers."""
    kept = []
    for i, label, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(1024 * x) for x in v]))
    length = -(-max((len(v) for *_, v in kept), default=0) // parts)
    kept = sorted(((i, label, v + [0] * (parts * length - len(v))) for i, label, v in kept), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = [[tuple(v[p * length:(p + 1) * length]) for p in range(parts)] for *_, v in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            member = {}
            for c in cut:
                member.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(member[e]) for x in zip(*member[e])) if e in member else y for e, y in enumerate(books[p])]
    out, by_label = [], Counter()
    for (i, label, _), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] += error
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), error))
    digest = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, label, code, error in out), key=str)


def coded(rows, **kw):
    codes, books = vector_codes.quantize(rows, **kw)
    from pyspark.sql import functions as F

    codes = codes.select("vec_id", "label", F.expr("lower(array_join(transform(code, c -> lpad(hex(c), 2, '0')), ''))").alias("code"),
                         F.expr("aggregate(distance, 0L, (a, x) -> a + x)").alias("error"))
    digest = vector_codes.codebook_digest(books)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, digest) for r in vector_codes.with_label_error(codes).collect()), key=str)


SCHEMA = "vec_id long, label int, embedding array<float>, v string, code int, distance int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def test_vector_codes(spark):
    rng = random.Random(4)
    some = lambda n: [rng.choice([rng.uniform(-0.02, 0.02), 0.5, -0.25]) for _ in range(n)]
    rows = [(rng.randrange(400), rng.choice([None, 1, 2, 3]), some(8)) for _ in range(400)]
    rows += [rows[0]] * 30 + [(None, 1, some(8)), (None, None, some(8)), (3, None, None), (4, 2, [1.0, None] * 4), (6, 2, [math.nan] * 8),
                              (7, 1, [math.inf] + [0.0] * 7), (8, 1, [-math.inf] * 8)]
    for entries in (256, 7):
        assert coded(vectors(spark, rows), entries=entries) == lloyd(rows, entries=entries)


def test_vector_codes_edges(spark):
    ragged = [(i, None, v) for i, v in enumerate([[], [1.0], [0.5, 0.25, 0.75, 1.5, 2.0], [0.1] * 9])]
    assert coded(vectors(spark, ragged)) == lloyd(ragged)
    assert coded(vectors(spark, [(1, 1, []), (2, 1, [])])) == lloyd([(1, 1, []), (2, 1, [])])
    assert coded(vectors(spark, [(1, 1, None)])) == coded(vectors(spark, []).where("false")) == []
    large = [(i, 1, [2.0 ** 12 * i, -3.5 * i, 1.0 * (i % 3), 2.0 ** 17]) for i in range(40)]  # beyond exact doubles
    assert coded(vectors(spark, large), entries=5) == lloyd(large, entries=5)
    with pytest.raises(ArithmeticError):
        coded(vectors(spark, [(1, 1, [1e30] * 4)]))


def test_reassigned_equals_full_search():
    rng = np.random.default_rng(0)
    x, book = rng.integers(-3, 4, (500, 3)), rng.integers(-3, 4, (12, 3))
    code, far = vector_codes.nearest(x, book)
    for _ in range(30):
        new, moved = book.copy(), rng.random(12) < 0.3
        new[moved] = rng.integers(-3, 4, (int(moved.sum()), 3))
        moved = (new != book).any(1)
        code, far = vector_codes.reassigned(x, code, far, new, moved)
        want = vector_codes.nearest(x, new)
        assert (code == want[0]).all() and (far == want[1]).all()
        book = new


# ---- alignment ---------------------------------------------------------------------------------

def aligned(rows):
    """Whole texts, one by one."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    import public_tokenizers

    a_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    b_side = sentencepiece.SentencePieceProcessor(model_file=alignment.tokenizer_paths()[1])
    a_side.encode_special_tokens = True
    # printable bytes stand for themselves, the others follow from 256 on
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in itself)}
    assert set(letter) == set(pre_tokenizers.ByteLevel.alphabet())
    seen, found = Counter(), []
    for did, t in rows:
        found.append((did, None))
        if not t:
            continue
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        bytes_a = [bytes(letter[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.IsByte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == (" " + t).encode() == b"".join(bytes_b):
            continue
        owner_a = [i for i, x in enumerate(bytes_a) for _ in x]
        owner_b = [i for i, x in enumerate(bytes_b) for _ in x]
        pairs = list(dict.fromkeys(zip(owner_a, owner_b)))  # one per overlapping pair, in order
        groups, last = [], (0, 0)
        for i, (x, y) in enumerate(pairs):
            if i + 1 == len(pairs) or (pairs[i + 1][0] > x and pairs[i + 1][1] > y):
                groups.append(",".join(map(str, a[last[0]:x + 1])) + "|" + ",".join(map(str, b[last[1]:y + 1])))
                last = x + 1, y + 1
        links = [(a[x], b[y]) for x, y in pairs]
        seen.update(set(links))
        found[-1] = did, (len(a), len(b), len(groups), links, ";".join(groups))
    best = Counter()
    for (x, _), n in seen.items():
        best[x] = max(best[x], n)
    return sorted(((did, 0, 0, 0, 0, 0, 0, "") if f is None else
                   (did, *f[:3], len(f[3]), sum(seen[p] == best[p[0]] for p in f[3]), sum(seen[p] for p in f[3]), hashlib.sha256(f[4].encode()).hexdigest())
                   for did, f in found), key=str)


def test_alignment(spark, docs, monkeypatch):
    want = aligned([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[1] == 0 for w in want) > 10 and sum(w[1] > 0 for w in want) > 100
    for table_pairs, fan_in in ((alignment.TABLE_PAIRS, 32), (400, 2)):  # several tables, several levels of the tree
        monkeypatch.setattr(alignment, "FAN_IN", fan_in)
        out = alignment.align(docs, table_pairs=table_pairs).select("doc_id", *alignment.GROUPS, "groups_sha256")
        assert sorted(map(tuple, out.collect()), key=str) == want


def test_pair_table(spark, docs):
    paths = alignment.tokenizer_paths()
    got = alignment.pair_table(spark, alignment.pair_counts(docs, paths), alignment.vocabulary(paths)[1]).collect()
    texts = [r.text for r in docs.collect() if r.text]
    pair, want = alignment.Pair(*paths), Counter()
    for t in texts:
        want.update(set(pair.aligned([" " + t])[1].pairs.tolist()))
    assert {(r.a * pair.width + r.b): r.n_docs for r in got} == want and len(got) == len(want)


def test_alignment_empty(docs):
    assert alignment.align(docs.where("false")).count() == 0
    none = alignment.align(docs.where("text is null or text = ''")).collect()
    assert none and all(r.n_a == r.count_sum == 0 and r.groups_sha256 == "" for r in none)


def test_cut_at_spaces():
    for t in odd_texts(3000, 20, 9):
        assert " ".join(at_spaces(t)) == t


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**32, 20_000, dtype=np.uint32))
    levels = alignment.unpacked(*alignment.packed(alignment.perfect_hash(keys)))
    assert sorted(alignment.index_of(keys, levels).tolist()) == list(range(len(keys)))
    assert sum(map(len, levels)) < 5 * len(keys)
    assert alignment.perfect_hash(keys[:0]) == []
