from __future__ import annotations

import re

import pytest

from tidemark.llm import licenses


def words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain(text: str | None):
    w = words(text or "")
    places = [(i, label) for i in range(len(w)) for p, label in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
    labels, share = {x for _, x in places}, 0.0
    blocks = [words(b) for b in re.sub(r"([.!?])[ \t\r]+", "\\1\n", text or "").split("\n")]
    longest = max(len(t.split()) for t in licenses.NOTICES.values())
    for sentence in re.split(r"(?<=[.!?])[ \t\r\n]+|\n[ \t\r]*\n[ \t\r\n]*", text or ""):
        if "\n" in sentence:
            run = words(sentence)
            blocks += [run[i : i + 2 * longest] for i in range(0, len(run), longest)]
    for block in map(set, blocks):
        for label, notice in licenses.NOTICES.items():
            notice, telling, foreign = (set(t.split()) for t in (notice, licenses.TELLING.get(label, ""), licenses.FOREIGN.get(label, "")))
            common = len(notice & block)
            if common >= licenses.CONTAINMENT * len(notice) - 1e-9 and telling <= block and not foreign & block:
                labels, share = labels | {label.partition("#")[0]}, max(share, common / len(notice))
    at = [i for i, _ in places]
    base = ",".join(sorted({x for _, x in places}))
    return len(w), len(at), min(at, default=None), max(at, default=None), base, ",".join(sorted(labels)), 1.0 if at else share


TEXTS = [
    "", None, " .. ", "cc by", "CC-BY; cc by cc by", "acc by", "General public\nlicense and General Public License", "All Rights Reserved.",
    "Released under the MIT License.", "released under mit license", "under the mit", "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. Next sentence. Licensed under CC BY-NC 4.0.",
    "the of and in to is this with or under license", "é cc by é", "word " * 20000 + "all rights reserved", "the under " * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "general public", "public license",
]


def test_scan_matches_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "cc by", "x"), (3, "cc by", "x"), (3, "all rights reserved", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = sorted(((r[0], *r[1:]) for r in licenses.scan(docs).collect()), key=repr)
    assert got == sorted(((i, *plain(t)) for i, t, _ in rows), key=repr)


LABELS = {
    "CC BY 4.0": "cc-by", "Licensed under CC BY 4.0": "cc-by,cc-by-4.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Licensed under CC BY-SA 4.0": "cc-by,cc-by-sa-4.0", "licensed under cc by-nc-sa 4.0": "cc-by,cc-by-nc-sa-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
    "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
    "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
    "This work is licensed under the GNU Lesser General Public License version 3": "gpl,lgpl",
    "Licensed under the GNU Affero General Public License, version 3": "agpl-3.0,gpl",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "gpl,lgpl",
    "released under the BSD license": "bsd", "released under the MIT license": "mit", "Licensed under the License version 2.0": "",
    "Licensed under the Apache License, Version 2.0": "apache-2.0", "released under the X license": "", "GPL 2": "", "BSD": "", "LGPL": "",
    "Licensed under the Apache License\nversion 2.0": "apache-2.0", "Released\nunder the\nBSD license": "bsd",
}


def test_labels_of_licenses_that_share_most_words(spark):
    docs = spark.createDataFrame(list(enumerate(LABELS)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(LABELS)} == LABELS
    assert all(plain(t)[5] == want for t, want in LABELS.items())


def test_no_line_of_the_table_has_two_conditions_at_once(spark):
    for r in licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("labels").distinct().collect():
        assert not {"cc-by-nc-4.0", "cc-by-sa-4.0"} <= set(r.labels.split(","))


WRAPPED = {
    "bsd": "Copyright (c) X.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. Redistributions",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files (the \"Software\"), to deal",
    "isc": "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n# copyright",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software",
}


def test_notices_over_several_lines(spark):
    texts = [*WRAPPED.items(), *((k, f"{'one two three\n' * 5000}{t}{'\nfour five' * 5000}") for k, t in WRAPPED.items())]
    apart = "\n\n".join(WRAPPED["mit-text"].split("\r\n"))
    docs = spark.createDataFrame([*enumerate(t for _, t in texts), (99, apart)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(texts)) and got[99] == [""]


@pytest.mark.parametrize("containment", [0.3, 0.5, 1.0])
def test_join_loses_no_pair_at_any_threshold(spark, containment):
    notices = {"a": "p q r s", "b": "q r x y z", "c": "the p"}
    texts = [" ".join(w for k, w in enumerate("p q r s x y z the".split()) if n >> k & 1) for n in range(256)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, _t string")
    got = {r["k"]: (set(r["found"]), r["share"]) for r in licenses.matches(docs, ["k"], notices, containment).collect()}
    want = {}
    for i, t in enumerate(texts):
        share = {n: len(set(w.split()) & set(t.split())) / len(set(w.split())) for n, w in notices.items()}
        if found := {n for n, s in share.items() if s >= containment - 1e-9}:
            want[i] = (found, max(share[n] for n in found))
    assert got == want


def test_empty_table_and_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    assert licenses.scan(docs.limit(0)).collect() == []
    scanned = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Cartesian" not in plan and "NestedLoop" not in plan
