"""Training-data operators against brute force, on edge cases and in exact round trips."""

import hashlib
import math
import os
import re
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tickloom.llm import bytesops as B  # noqa: E402
from tickloom.llm import (chat, decontamination, licenses, line_dedup, lm_scoring, near_dedup, packing,  # noqa: E402
                          quality, sharding, suffix_dedup)
from tickloom.llm.common import NO_ID  # noqa: E402

LOW = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKED = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"wörd{i % 97} Ünder{i}" for i in range(4000))
PASSAGE = "the quick brown fox jumps over the lazy dog while nine other words follow it closely and then some more of them"
TEXTS = {
    1: f"Intro one\n{PASSAGE}\nshort\n Licensed under the Apache License, Version 2.0. ", 2: f"{PASSAGE} tail that differs\nshort\nshort\n{PASSAGE}",
    3: None, 4: "", 5: "\n\n", 6: f"Intro ONE  \n{PASSAGE.upper()}\nCC BY NC words under the MIT license under the mit license", 7: LONG, 8: LONG,
    9: LONG.replace("wörd5 ", "other "), 10: "a\tb  c \n d", 11: "é ü ñ # $ | & <b>", 12: "one two three four five six seven eight nine ten one two three four five six seven eight nine ten",
    13: f"{PASSAGE} tail that differs\nshort\nshort\n{PASSAGE}", 14: "tiny", 15: "tiny", 16: "x" * 300, 17: "x" * 120 + "y", 18: "\x00" * 60 + "z",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"row{i}", 1, 2) for i, t in TEXTS.items()] + [(None, "no id here at all", None, None, None, None), (14, "tiny", "en", "again", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, did long, tid long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def plain(docs):
    return [(NO_ID if r.doc_id is None else r.doc_id, r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_line_dedup(docs, empty):
    rows = plain(docs)
    key = lambda line: LOW(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for did, _, t in rows:
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), did), did)
    want = []
    for did, i, t in rows:
        kept = [line for line in t.split("\n") if first.get(key(line), did) == did]
        want.append((i, len(t.split("\n")), len(t.split("\n")) - len(kept), sha("\n".join(kept))))
    for fanout in (2, 9):
        out = line_dedup.dedup_lines(docs, batches=5, fanout=fanout)
        got = out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("k")).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_suffix_dedup(docs, empty, monkeypatch):
    rows = plain(docs)
    first = {}
    for did, _, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], did), did)
    want = []
    for did, i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < did:
                gone[k + 1:k + 51] = True
        want.append((did, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(bytes(c for c, g in zip(b, gone[1:-1]) if not g))))
    for hot in (20_000, 0):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = suffix_dedup.dedup_substrings(docs).drop("spans").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert suffix_dedup.dedup_substrings(empty).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(3)
    for top in (2, 4, 256):
        parts = [rng.integers(0, top, int(n)).astype(np.uint8) for n in rng.integers(12, 60, 40)]
        t = np.concatenate(parts + parts[:9])
        size = np.array([len(p) for p in parts + parts[:9]])
        end = np.cumsum(size)
        sa, lcp = suffix_dedup.two_stage(t, end - size, end, 12)
        strings = [bytes(t[i:i + 12]) for i in sa]
        assert strings == sorted(strings) and len(sa) == (size - 11).sum() == len(set(sa.tolist()))
        assert lcp.tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(strings, strings[1:])]


def test_decontamination(spark, docs, empty):
    items = {1: PASSAGE, 2: "lazy dog", 3: None, 4: "", 5: "never seen words only", 6: "CC by, nc"}
    bench = spark.createDataFrame(list(items.items()) + [(None, "tiny")], "item_id long, text string")
    windows = {}
    for i, t in items.items():
        w = WORD.findall(LOW(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    want = []
    for _, i, t in plain(docs):
        w, hit, it = WORD.findall(LOW(t)), set(), set()
        for win, named in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    it |= named
        want.append((i, len(w), len(hit), sorted(it), bool(hit)))
    for block in (1 << 20, 5):
        got = decontamination.contamination(docs, bench, block_words=block).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.where("false")).where("contaminated").count() == 0
    near = decontamination.contamination(spark.createDataFrame([(1, "dog so very lazy")], "doc_id long, text string"), bench).first()
    assert near.n_near == 1 and not near.contaminated


def test_quality(spark, docs, empty):
    want = []
    for _, i, t in plain(docs):
        w = BLANKED.findall(t)
        grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        c, covered, seen, dup = Counter(grams), set(), set(), 0
        for k, g in enumerate(grams):
            if c[g] > 1:
                covered.update(range(k, k + 8))
        for line in t.split("\n"):
            if BLANKED.search(line):
                dup += line in seen
                seen.add(line)
        want.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    got = quality.quality_scores(docs, None)
    assert sorted(map(str, map(tuple, got.select("doc_id", *quality.STAT_NAMES, "base_failed").collect()))) == sorted(map(str, want))
    assert got.where("kept = base_failed or quality_score is not null").count() == 0
    assert quality.quality_scores(empty, None).count() == 0
    kept = quality.keep_good(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()


def test_quality_learns(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 60) + rng.choice(list("abcdefgh"), 60).astype(object))
    rows = [(i, good() if i % 3 else good().replace(" ", "### "), int(i % 3 > 0)) for i in range(300)]
    all_ = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(all_, all_.where("doc_id < 200"))
    s = quality.quality_scores(all_.where("doc_id >= 200"), model).join(all_, "doc_id").select("quality", "quality_score").toPandas()
    assert ((s.quality_score > 0.5) == (s.quality == 1)).mean() > 0.97 and s.quality_score.between(0, 1).all()


def test_quality_fits_in_little_memory_and_as_in_one_pass():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    n, k = 1500, 600
    idx = np.sort(rng.integers(0, 2 * quality.DIM, (n, k)), axis=1).astype(np.uint16)
    val = rng.random((n, k)).astype(np.float32)
    table = pa.table({"doc_id": rng.permutation(n), "quality": pa.array(rng.integers(0, 2, n), pa.int32()),
                      "idx": pa.array([x.tobytes() for x in idx], pa.binary()), "val": pa.array([x.tobytes() for x in val], pa.binary())})
    y, held, blocks = quality.blocks_of(table)
    tracemalloc.start()
    w, b = quality.descend(blocks, y, ~held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * n * k  # less than one double for every feature of every document
    whole = [(np.flatnonzero(~held), *(np.concatenate([x[i] for x in blocks if not held[x[0][0]]]) for i in (1, 2)),
              np.concatenate([np.searchsorted(np.flatnonzero(~held), x[0])[x[3]] for x in blocks if not held[x[0][0]]]))]
    w1, b1 = quality.descend(whole, y, ~held)
    assert np.array_equal(w, w1) and b == b1


def test_licenses(docs, empty):
    want = []
    for _, i, t in plain(docs):
        w, at, bl, ml, best = WORD.findall(LOW(t)), [], set(), set(), 0.0
        for p, label in licenses.PHRASES.items():
            for k in range(len(w)):
                if w[k:k + len(p.split())] == p.split():
                    at.append(k)
                    bl.add(label)
        for line in t.split("\n"):
            s = set(WORD.findall(LOW(line)))
            for label, text in licenses.TEMPLATES:
                have = licenses.template_tokens(text)
                if len(s & set(have)) >= licenses.THRESHOLD * len(have) - 1e-9:
                    ml.add(label)
                    best = max(best, len(s & set(have)) / len(have))
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(bl)), ",".join(sorted(bl | ml)), best))
    got = licenses.scan(docs).drop("n_blocks").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and any(r.labels for r in got)
    assert licenses.scan(empty).count() == 0


def test_licenses_across_lines_and_not_scattered(spark):
    filler = " ".join(f"f{i}" for i in range(50))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    texts = [mpl, bsd, *(f"{' '.join(['x'] * k)} {mpl} {filler}" for k in range(18)), f"all {filler} rights {filler} reserved", f"{filler} All\nrights reserved"]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.labels for r in got.orderBy("doc_id").collect()] == ["mpl-2", "bsd", *["mpl-2"] * 18, "", "all-rights-reserved"]


def test_sharding(docs, empty):
    got = sharding.shard_plan(docs, 4).toPandas()
    assert len(got) == docs.count() and got["size"].sum() == sum(len(t.encode()) + 8 for _, _, t in plain(docs))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    loads = got.groupby("shard")["size"].sum()
    assert loads.max() - got["size"].sum() / 4 <= got["size"].max()
    real = got[got.doc_id.notna()].sort_values("doc_id")
    assert real["shard"].is_monotonic_increasing
    assert set(zip(got.doc_id.fillna(-1), got.text_crc32)) == {(-1 if i is None else i, zlib.crc32(t.encode())) for _, i, t in plain(docs)}
    assert sharding.shard_plan(empty, 4).count() == 0


def test_chat_round_trip(spark):
    rows = [(c, k, ["system", "user", "assistant", None, "as<s\n"][(k + c) % 5], ["plain", None, r"\b \l <turn 3 new>x</turn>" + "\n", "", "é" * 900, chat.PROBE][(k * 7 + c) % 6])
            for c in range(6) for k in range(40)]
    rows += [(None, 0, "assistant", "x"), (9, 1, "assistant", "same"), (9, 1, "assistant", "same"), (9, None, "user", "late")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.windows(turns, span=64, history=32)
    read = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(math.inf if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c])
        assert [(t.role, t.text) for t in read[c].turns] == [(r, t) for _, r, t in own]
        assert read[c].loss_text == "".join(t for _, r, t in own if r == "assistant")
    sizes = out.withColumn("new", F.size(F.split("formatted", " new>")) - 1).where("new > 1").select(F.max(F.length("formatted"))).first()[0]
    assert sizes < (64 + 32) * 4 + 4000
    assert chat.windows(turns.where("false")).count() == 0


def test_contexts_of_the_most_symbols_fit():
    base = lm_scoring.checked_base(int(1 / lm_scoring.SYMBOL_SHARE) + 1)
    codes = lm_scoring.histories(np.full(lm_scoring.DEPTH + 1, base - 1), np.array([lm_scoring.DEPTH + 1]), lm_scoring.DEPTH, base)
    assert int(codes[-1][-1]) == base**lm_scoring.DEPTH - 1 and int((codes[-1] * base + base - 1)[-1]) == base ** (lm_scoring.DEPTH + 1) - 1
    with pytest.raises(ValueError):
        lm_scoring.checked_base(60_000)


def test_encoder_equals_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.WordEncoder(packing.tokenizer_path(), packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    odd = ["<|endoftext|>", "a  <|endoftext|> <|endoftext|><|endoftext|>\n b ", "x<|endoftext|", " <|endoftext|>  y", "<<|endoftext|>>",
           "", " ", "  a", "a  b ", "a \n b", "\n\n x\t y  ", "it's  don't  1 2", "x\r\n  y", "<|endoftext|> q", "a\t b", "　 a  b", LONG]
    rng = np.random.default_rng(8)
    bits = ["<|endoftext|>", "<|end", "|>", " ", "  ", "\n", "it's", "word", "é", "12", "\t", "\u3000"]
    odd += ["".join(rng.choice(bits, int(rng.integers(1, 12)))) for _ in range(2000)]
    for x in odd + [x or "" for x in TEXTS.values()]:
        ids = t.encode(x, add_special_tokens=False).ids
        assert e.encode(x) == struct.pack(f"<{len(ids)}I", *ids)


def test_packing(docs, empty):
    got = packing.pack(docs).toPandas()
    e = packing.WordEncoder(packing.tokenizer_path(), packing.added_tokens(packing.tokenizer_path("byte_bpe_50k.json")))
    want = Counter((i, e.encode(t) + bytes(4)) for _, i, t in plain(docs))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.concatenate([[0], np.cumsum(g.length)[:-1]]).tolist() and g.length.sum() <= 1024
    for (i, ids), n in want.items():
        g = got[(got.doc_id == i) if i is not None else got.doc_id.isna()].sort_values("start", kind="stable").drop_duplicates("start")
        assert b"".join(g.ids) == ids and (g.doc_tokens == len(ids) // 4).all()
        assert [zlib.crc32(x) for x in g.ids] == g.ids_crc32.tolist()
    assert got.length.sum() == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    assert packing.pack(empty).count() == 0


def test_differencing():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes = rng.integers(1, 257, int(rng.integers(1, 150))).tolist()
        groups = packing.windows_of(sizes, 1024)
        assert sorted(i for g in groups for i in g) == list(range(len(sizes)))
        loads = [sum(sizes[i] for i in g) for g in groups]
        assert max(loads) <= 1024 and len(groups) <= -(-sum(sizes) // 1024) + 1


def test_lm_scoring(docs, empty):
    rows = plain(docs)
    tokens = [(i, BLANKED.findall(LOW(t)) + ["\0"]) for _, i, t in rows]
    train = Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, types = sum(train.values()), len(train)
    want = {}
    for i, ws in tokens:
        want[i] = (i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(w in train for w in ws), total)
        base = sum(math.log10((train[w] + 1) / (total + types + 1)) for w in ws)
        want[i] += (base,)
    got = lm_scoring.score_documents(docs, buckets=3).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and r.base_score == pytest.approx(want[r.doc_id][4])
        assert r.score < 0
    assert lm_scoring.score_documents(empty).count() == 0


def test_lm_states_sum_to_one():
    rng = np.random.default_rng(2)
    base, total, types = 6, 1000, 50
    count = np.array([400, 200, 150, 120, 80, 50])
    p0 = (count + np.where(np.arange(base) == 0, types + 1 - (base - 1), 1)) / (total + types + 1)
    assert p0.sum() == pytest.approx(1)
    ctx, sym = np.repeat([1, 3], 3), np.tile([0, 2, 4], 2)
    n = rng.integers(5, 40, 6)
    size = np.repeat([n[:3].sum() + 9, n[3:].sum() + 2], 3)
    rest = 1 - np.add.reduceat(n, [0, 3]) / (size[[0, 3]] + lm_scoring.MASS)
    p = n / (size + lm_scoring.MASS) + np.repeat(rest, 3) * p0[sym]
    node = {"ctx": np.array([1, 3]), "rest": rest, "key": ctx * base + sym, "p": p}
    for c in range(base):
        s = np.arange(base)
        assert lm_scoring.step(node, np.full(base, c), s, p0[s], base).sum() == pytest.approx(1)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_dedup(docs, empty):
    rows = plain(docs)
    sets = {}
    for did, _, t in rows:
        w = BLANKED.findall(LOW(t))
        k = min(5, len(w))
        sets[did, t] = frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    group = {did: did for did, _, _ in rows}
    for _ in range(3):
        for (a, ta), sa in sets.items():
            for (b, tb), sb in sets.items():
                if ta == tb or (sa and sb and jaccard(sa, sb) >= 0.8):
                    group[a] = group[b] = min(group[a], group[b])
    got = near_dedup.near_classes(docs).collect()
    assert len(got) == len(rows) and {(r.did, r.class_did) for r in got} == {(d, group[d]) for d, _, _ in rows}
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))
    assert near_dedup.near_classes(empty).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    e = B.mix(np.arange(1, 301, dtype=np.uint64))
    x, y = rng.integers(0, 4, 300) * 0.75, rng.integers(0, 4, 300) * 0.75
    y[:200] = x[:200]
    true = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    on = [np.flatnonzero(v) for v in (x, y)]
    sig = near_dedup.dart_signatures(np.concatenate([e[o] for o in on]), np.repeat([0, 1], [len(o) for o in on]),
                                     np.concatenate([x[on[0]], y[on[1]]]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.03


def test_many_near_copies(spark):
    base = [f"word{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + ["changed"] + base[i + 1:])) for i in range(90)] + [(1000, " ".join(f"other{i}" for i in range(100)))]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_did for r in got} == {0, 1000}


def test_near_dedup_star_whose_hub_is_not_the_least(spark):
    # each edit is near the original (Jaccard 0.82) and not near the other edits (0.70)
    base = [f"word{i}" for i in range(300)]
    rng = np.random.default_rng(6)
    edits = []
    for i in range(120):
        at = set((int(rng.integers(0, 50)) + 50 * np.arange(6)).tolist()) if i else set(range(3, 300, 50))
        edits.append(" ".join(f"e{i}x{k}" if k in at else w for k, w in enumerate(base)))
    rows = [(i, t) for i, t in enumerate(edits)] + [(1000, " ".join(base)), (2000, " ".join(f"other{i}" for i in range(100)))]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(i, 0) for i in [*range(120), 1000]} | {(2000, 2000)}
    assert {(r.did, r.class_did) for r in near_dedup.near_classes(rows, neighbours=1).collect()} == want
    # the exact join alone finds every pair between classes
    texts = rows.select(F.col("doc_id").alias("did"), "text")
    sets = near_dedup.shingle_sets(texts).withColumn("c", F.col("did"))
    got = near_dedup.verified(near_dedup.prefix_pairs(sets, 0.8), sets, 0.8).collect()
    whole = {r.did: set(np.frombuffer(r.set, np.uint64).tolist()) for r in sets.collect()}
    true = {(a, b) for a in whole for b in whole if a < b and jaccard(whole[a], whole[b]) >= 0.8}
    assert {(r.a, r.b) for r in got} == true and len(true) >= 120


def test_rows_without_or_with_repeated_ids_are_judged_by_their_text(spark):
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(60))
    leak = f"before {PASSAGE} after"
    rows = [(1, text(1)), (None, text(1)), (None, text(1) + " more"), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)),
            (9, text(5) + " more"), (8, text(4) + " more"), (None, leak), (7, leak)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {(r.doc_id, r.text) for r in near_dedup.keep_one_of_each(docs).collect()}
    assert kept == {(1, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, leak)}
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    clean = [(r.doc_id, r.text) for r in decontamination.keep_clean(docs, bench).collect()]
    assert sorted(map(str, clean)) == sorted(str(r) for r in rows if r[1] != leak)


def test_pipeline_keeps_columns_and_clean_documents(spark, tmp_path):
    path = str(tmp_path)
    clean = [(i, " ".join(f"w{i}x{k} the and" for k in range(30)), "en", "s", 5) for i in range(20)]
    leak = (50, "before it " + PASSAGE + " after it all the way to the very end", "en", "s", 5)
    copy = (60, clean[3][1] + " more", "en", "s", 5)
    spark.createDataFrame([*clean, leak, copy, (70, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        docs = out
    assert {r.doc_id for r in docs.collect()} == set(range(20))
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(range(20))
