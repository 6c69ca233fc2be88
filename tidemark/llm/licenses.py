"""License scans with DataFrame functions only: phrases in place, and an exact set-similarity join with license notices.

A notice is a set of words; a text block (a sentence or line, or a run of words of a sentence that goes over several lines) matches
if it contains at least ``CONTAINMENT`` of them. The
words of all notices are ordered by the number of blocks of the whole corpus that have them, rarest first. Of a notice
of m words that must share a of them with a block, only the first m - a + 1 are indexed, of a block's n likewise
n - a + 1 are looked up (prefix filter); blocks with fewer than a known words are left out (length filter), and so are pairs
whose remaining words after the common one cannot make up a (positional filter). Every pair left is counted exactly.
Notices of different licenses share most of their words. So a pair gives its label only if the block has all words that tell the license
(its name, version or conditions) and none that tells another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTAINMENT = 0.8

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words of usual license notices by SPDX-like label; what follows # tells notices of one label apart.
NOTICES = {
    "agpl-3.0": "licensed under the gnu affero general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd#name": "released under the bsd license",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-4.0#short": "licensed under cc by 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-nc-sa-4.0": "licensed under cc by nc sa 4 0",
    "cc-by-nd-4.0": "licensed under cc by nd 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-2.0": "this work is licensed under the gnu general public license version 2",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}

#: Words of a notice that tell its license from others, all of which a block must have.
TELLING = {
    "agpl-3.0": "affero 3", "apache-2.0": "apache 2", "bsd#name": "bsd", "cc-by-4.0": "creative commons attribution 4", "cc-by-4.0#short": "cc by 4",
    "cc-by-nc-4.0": "cc by nc 4", "cc-by-nc-sa-4.0": "cc by nc sa 4", "cc-by-nd-4.0": "cc by nd 4", "cc-by-sa-4.0": "cc by sa 4",
    "gpl-2.0": "general public 2", "gpl-3.0": "general public 3", "gpl-notice": "general public", "lgpl": "lesser", "mit": "mit", "mpl-2.0": "mozilla 2",
    "unlicense": "unencumbered",
}
#: Words that tell another license, none of which a block may have.
FOREIGN = {
    "cc-by-4.0": "noncommercial sharealike noderivatives nc sa nd", "cc-by-4.0#short": "nc sa nd", "cc-by-nc-4.0": "sa nd", "cc-by-nc-sa-4.0": "nd",
    "cc-by-nd-4.0": "nc sa", "cc-by-sa-4.0": "nc nd", "gpl-2.0": "lesser library affero", "gpl-3.0": "lesser library affero",
    "gpl-notice": "lesser library affero",
}

_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one blank between them."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _DELIMITERS, " "))


def blocks(text: Column) -> Column:
    """The sentences and lines of a text."""
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n")


def runs_over_lines(text: Column, longest: int) -> Column:
    """Runs of ``2 * longest`` words of each sentence that a line break cuts; any ``longest`` words in a row stand in one of them.

    A blank line ends a sentence, too.
    """
    sentences = F.split(text, r"(?<=[.!?])[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*")

    def runs(sentence: Column) -> Column:
        part = F.regexp_extract_all(spaced(sentence), F.lit(f"(?:[^ ]+ ?){{1,{longest}}}"), F.lit(0))
        both = F.arrays_zip(part.alias("here"), F.slice(part, F.lit(2), F.size(part)).alias("after"))
        return F.transform(both, lambda p: F.concat_ws(" ", p["here"], p["after"]))

    return F.flatten(F.transform(F.filter(sentences, lambda s: F.contains(s, F.lit("\n"))), runs))


def phrase_places(docs: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``base`` (labels) to documents with a text ``_t``."""
    docs = docs.withColumn("_s", spaced(F.col("_t")))
    padded = F.concat(F.lit(" "), "_s", F.lit(" "))
    has = [F.contains(padded, F.lit(f" {p} ")) for p in PHRASES]
    some = has[0]
    for h in has[1:]:
        some = some | h
    word = F.split("_s", " ")
    n = F.size(word)
    longest = max(len(p.split()) for p in PHRASES)
    # Words beside those that follow them, so that no lambda refers to the array again.
    runs = F.arrays_zip(*[F.slice(word, F.lit(k + 1), F.greatest(n - k, F.lit(0))).alias(f"w{k}") for k in range(longest)])

    def starts(run: Column, i: Column) -> Column:
        label = F.lit(None).cast("string")
        for phrase, name in PHRASES.items():
            here = F.lit(True)
            for k, w in enumerate(phrase.split()):
                here = here & (run[f"w{k}"] == w)
            label = F.when(here, name).otherwise(label)
        return F.struct(i.cast("long").alias("at"), label.alias("label"))

    places = F.filter(F.transform(runs, starts), lambda p: p["label"].isNotNull())
    none = F.expr("array()").cast("array<struct<at:bigint,label:string>>")
    blanks = F.length("_s") - F.length(F.replace(F.col("_s"), F.lit(" "), F.lit("")))
    docs = docs.withColumn("n_words", F.when(F.col("_s") == "", 0).otherwise(blanks + 1).cast("long"))
    docs = docs.withColumn("_p", F.when(some, places).otherwise(none)).drop("_s")
    return docs.select(
        *[c for c in docs.columns if c not in ("_p", "_t")],
        F.size("_p").cast("long").alias("n_base"),
        F.array_min("_p.at").alias("first_word"),
        F.array_max("_p.at").alias("last_word"),
        F.array_distinct("_p.label").alias("base"),
    )


def _known(vocabulary: list[str]) -> Column:
    """The words of ``vocabulary`` in the block ``_b``, in the order of ``vocabulary``."""
    return F.array_intersect(F.array(*map(F.lit, vocabulary)), F.split(spaced(F.col("_b")), " "))


def word_order(docs: DataFrame, notices: dict[str, str]) -> list[str]:
    """The words of the notices, those in the fewest blocks of all documents first; as many rows as words are read."""
    vocabulary = sorted({w for t in (*notices.values(), *(FOREIGN.get(n, "") for n in notices)) for w in t.split()})
    count = (
        docs.select(F.explode(blocks(F.col("_t"))).alias("_b"))
        .select(F.explode(_known(vocabulary)).alias("word"))
        .groupBy("word").count().collect()
    )
    seen = {r["word"]: r["count"] for r in count}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _index(spark: SparkSession, notices: dict[str, str], order: list[str], containment: float) -> DataFrame:
    """One row per indexed word of each notice: (word, i, label, m, a, words, telling, foreign)."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []

    def array(words: list[str]) -> str:
        return "cast(array(" + ", ".join(f"'{w}'" for w in words) + ") as array<string>)"

    for label, text in notices.items():
        words = sorted(set(text.split()), key=rank.get)
        a = math.ceil(containment * len(words) - 1e-9)
        all_ = ", ".join(map(array, (words, TELLING.get(label, "").split(), FOREIGN.get(label, "").split())))
        name = label.partition("#")[0]
        rows += [f"('{words[i]}', {i}, '{name}', {len(words)}, {a}, {all_})" for i in range(len(words) - a + 1)]
    return spark.sql("select * from values " + ", ".join(rows) + " as t(word, i, label, m, a, words, telling, foreign)")


def matches(docs: DataFrame, keys: list[str], notices: dict[str, str] = NOTICES, containment: float = CONTAINMENT) -> DataFrame:
    """(keys, labels, score): documents with a block that contains enough of a notice and tells its license, with the best containment."""
    order = word_order(docs, notices)
    index = _index(docs.sparkSession, notices, order, containment)
    least = min(math.ceil(containment * len(set(t.split())) - 1e-9) for t in notices.values())
    longest = max(len(t.split()) for t in notices.values())
    found = (
        docs.select(*keys, F.explode(F.concat(blocks(F.col("_t")), runs_over_lines(F.col("_t"), longest))).alias("_b"))
        .select(*keys, _known(order).alias("b"))
        .where(F.size("b") >= least)
        .select(*keys, "b", F.posexplode(F.slice("b", F.lit(1), F.size("b") - (least - 1))).alias("j", "word"))
    )
    n = F.size("b")
    # The index has a fixed number of rows, the notices' own.
    pairs = found.join(F.broadcast(index), "word").where(
        (n >= F.col("a"))
        & (F.col("j") <= n - F.col("a"))
        & (F.least("i", "j") + F.least(F.col("m") - F.col("i"), n - F.col("j")) >= F.col("a"))
    )
    pairs = pairs.withColumn("common", F.size(F.array_intersect("words", "b"))).where("common >= a")
    pairs = pairs.where((F.size(F.array_except("telling", "b")) == 0) & ~F.arrays_overlap("foreign", "b"))
    counted = pairs.select(*keys, "label", (F.col("common") / F.col("m")).alias("share"))
    return counted.groupBy(*keys).agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, places of phrases, labels of both kinds, and a score.

    ``score`` is 1 with a phrase in place, else the best containment of a matched notice, else 0. A null text is empty: no
    words, empty labels, null places. Rows of equal id and text share their matches; null ids and repeated ids stay
    rows of their own; other columns are not read; no rows give no rows.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))
    docs = docs.withColumn("_h", F.xxhash64("_t"))
    noticed = matches(docs, ["_id", "_h"]).select(F.col("_id").alias("_i"), F.col("_h").alias("_g"), "found", "share")
    placed = phrase_places(docs)
    joined = placed.join(noticed, (F.col("_h") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i")), "left")
    every = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    return joined.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
