"""Licence scan: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a window of twice a template's words; windows start every template length, over the whole text
and across line breaks, so every passage as long as the template lies inside one. Its token set is compared
with the template's by containment, the share of the template's tokens that the block holds. Tokens are ordered by their global frequency over all
blocks, rarest first. The join is exact: a block with enough tokens in common shares one within
the prefixes of both sides (prefix filter), is long enough (length filter) and has
enough left after the shared position on both sides (positional filter); what passes is verified
on the whole sets. Block tokens outside all templates cannot be shared and are left out first.

DataFrame functions only. Templates and phrases are parameters of fixed size, so their index and
the frequencies of their tokens may be broadcast; nothing that grows with the documents is.

Defined cases: null or empty text has no words, no places and no labels; repeated rows get the
same labels; a null doc_id keeps its row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, doc_order, doc_text, stored, table

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("all-rights-reserved", "All rights reserved"),
]
THRESHOLD = 0.9
WORDS = r"[0-9a-z\u0080-\U0010ffff]+"
#: characters outside words, but for the line break
NOT_WORD = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORDS, text.lower())))


def spaced(text: Column) -> Column:
    """Lower-cased words of each line with single spaces between."""
    return F.regexp_replace(ascii_lower(text), NOT_WORD, " ")


def blocks(docs: DataFrame, sets: list, vocab: list[str]) -> DataFrame:
    """(did, th, template, block, toks): template tokens of every window of the templates whose tokens the text holds."""
    every = F.array(*[F.lit(v) for v in vocab])
    shapes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(words).alias("words"), F.lit(need).alias("need"),
                                F.array(*[F.lit(t) for t in s]).alias("set")) for i, s, need, words in sets])
    rows = docs.select(doc_order().alias("did"), F.xxhash64(doc_text()).alias("th"), F.split(
        F.btrim(F.regexp_replace(spaced(doc_text()), "[ \n]+", " ")), " ").alias("words"))
    rows = rows.withColumn("held", F.array_intersect("words", every))
    rows = rows.select("did", "th", "words", F.explode(F.filter(
        shapes, lambda t: F.size(F.array_intersect("held", t["set"])) >= t["need"])).alias("t"))
    last = F.greatest(F.ceil(F.size("words") / F.col("t.words")).cast("int") - 2, F.lit(0))
    toks = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_intersect(
        F.slice("words", k * F.col("t.words") + 1, 2 * F.col("t.words")), every))
    return rows.select("did", "th", F.col("t.i").alias("template"), F.posexplode(toks).alias("block", "toks")).where(F.size("toks") > 0)


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(did, th, block, label, containment): every block that meets a template's threshold, no block twice per template."""
    spark = docs.sparkSession
    sets = [(i, label, template_tokens(text)) for i, (label, text) in enumerate(templates)]
    vocab = sorted({t for _, _, s in sets for t in s})
    need = {i: math.ceil(threshold * len(s) - 1e-9) for i, _, s in sets}
    shapes = [(i, s, need[i], len(re.findall(WORDS, text.lower()))) for (i, _, s), (_, text) in zip(sets, templates)]
    found = stored(blocks(docs, shapes, vocab), "blocks")
    # one count per template token: bounded by the templates
    counts = {r["t"]: r["count"] for r in found.select(F.explode("toks").alias("t")).groupBy("t").count().collect()}
    rank = {t: i for i, t in enumerate(sorted(vocab, key=lambda t: (counts.get(t, 0), t)))}
    index = [(i, label, t, j, len(s), need[i], s) for i, label, s in sets
             for j, t in enumerate(sorted(s, key=rank.get)[:len(s) - need[i] + 1])]
    index = spark.createDataFrame(index, "template int, label string, tok string, j int, size int, need int, all array<string>")
    by_rank = F.create_map(*[x for t in vocab for x in (F.lit(t), F.lit(rank[t]))])
    ordered = F.transform(F.array_sort(F.transform("toks", lambda t: F.struct(F.element_at(by_rank, t).alias("r"), t.alias("t")))),
                          lambda x: x["t"])
    least = min(need.values())
    long_enough = found.where(F.size("toks") >= least).select("did", "th", "template", "block", ordered.alias("toks"))
    prefix = long_enough.select("did", "th", "template", "block", "toks", F.posexplode(
        F.slice("toks", F.lit(1), F.size("toks") - least + 1)).alias("i", "tok"))
    left = F.size("toks") - F.col("i")
    pairs = prefix.join(F.broadcast(index), ["template", "tok"]).where(
        (F.size("toks") >= F.col("need")) & (left >= F.col("need"))
        & (F.least(F.col("i"), F.col("j")) + F.least(left, F.col("size") - F.col("j")) >= F.col("need")))
    overlap = F.size(F.array_intersect("toks", "all"))
    verified = pairs.where(overlap >= F.col("need")).select(
        "did", "th", "block", "template", "label", (overlap / F.col("size")).alias("containment"))
    return verified.dropDuplicates(["did", "th", "block", "template"])


def phrase_places(words: Column, text: Column, phrase: str) -> Column:
    """Starts of a phrase among the words; texts without it are not searched word by word."""
    parts = phrase.split(" ")
    hit = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)),
                   lambda i: F.slice(words, i + 1, len(parts)) == F.array(*[F.lit(p) for p in parts]))
    return F.when(F.contains(text, F.lit(f" {phrase} ")), hit).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, phrases=None, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks: one row per document."""
    phrases = PHRASES if phrases is None else phrases
    text = F.concat(F.lit(" "), F.btrim(F.regexp_replace(spaced(doc_text()), "[ \n]+", " ")), F.lit(" "))
    base = docs.select("doc_id", doc_order().alias("did"), F.xxhash64(doc_text()).alias("th"), text.alias("s"))
    base = base.select("doc_id", "did", "th", "s", F.when(F.col("s") == "  ", F.array().cast("array<string>")).otherwise(
        F.split(F.btrim("s"), " ")).alias("words"))
    places = {p: phrase_places(F.col("words"), F.col("s"), p) for p in phrases}
    base = base.select("doc_id", "did", "th", F.size("words").cast("long").alias("n_words"), F.concat(*places.values()).alias("at"),
                       F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(phrases[p])) for p, c in places.items()])).alias("bl"))
    per_doc = template_matches(docs, templates, threshold).groupBy("did", "th").agg(
        F.collect_set("label").alias("ml"), F.max("containment").alias("score"), F.countDistinct("template", "block").alias("n_blocks"))
    out = base.join(per_doc, ["did", "th"], "left")
    both = F.array_union("bl", F.coalesce("ml", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("bl")), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))


def op7(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_license_scan": (op7, None)}
