"""Licence notices in real shapes, and the whole scan against a plain version of it."""

import os
import re

import pytest

from quern.llm import license_scan as S

LGPL = "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
MIT = """# The MIT License (MIT)
#
# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction, including without limitation the rights
# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
# copies of the Software, and to permit persons to whom the Software is
# furnished to do so, subject to the following conditions:"""
ISC = "/*\n * Permission to use, copy, modify, and distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n */"
UNLICENSE = "Anyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans."
ESSAY = "He wrote an essay about software released under the MIT License and about the people who chose it."
DATA = "/root/testdata/sf0.001"


def plain(text, sample=()):
    """What scan() finds, piece by piece in Python."""
    out, n = [], 0
    for i, p in enumerate(re.split(S.BREAK, text or "")):
        n += bool(re.search(S.WORD, p))
        whole = re.sub(r"\n" + S.MARK, " ", re.sub("^" + S.MARK, "", p)).strip(" ")
        f = S.judge(whole, sample)[0]
        pieces = re.split(S.PIECE, p)
        if f or len(pieces) == 1:
            out += [f"{i}:{f}"] if f else []
        else:
            out += [f"{i}:{f}" for f in (S.judge(re.sub("^" + S.MARK, "", x), sample)[0] for x in pieces) if f]
    return n, ",".join(out)


def test_wrapped_notices(spark):
    texts = {1: LGPL, 2: MIT, 3: ISC, 4: UNLICENSE, 5: ESSAY, 6: "It was under the bridge in the city of the king\nand all of this was free", 7: f"{MIT}\n\n{ESSAY}\n \n{LGPL}\nand so on", 8: "some prose about a tree\nReleased under the MIT License.\nand more of the tree", 9: "", 10: "\n\n\n"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_paragraphs"], r["paragraphs"]) for r in S.digest(S.scan(d, sample=())).collect()}
    assert got == {k: plain(t) for k, t in texts.items()}
    assert [got[k][1] for k in range(1, 7)] == ["0:lgpl", "0:mit,1:mit", "0:isc", "0:unlicense", "", ""] and got[8][1] == "0:mit"
    assert got[7][1].startswith("0:mit,1:mit,") and got[7][1].endswith("3:lgpl") and "2:" not in got[7][1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_whole_table(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    sample = S.background(d)
    assert 50 < len(sample) <= 2000 and S.background(d.repartition(3)) == sample
    got = {r["doc_id"]: (r["n_paragraphs"], r["paragraphs"]) for r in S.digest(S.scan(d)).collect()}
    assert got == {r["doc_id"]: plain(r["text"], sample) for r in d.collect()} and sum(p != "" for _, p in got.values()) > 5


def test_templates_and_unknown_texts():
    texts = {s: k for k, group in S.TEMPLATES.items() for s in group}
    assert sum(S.judge(s)[0] == k for s, k in texts.items()) >= 0.95 * len(texts)
    held = S.examples(1500, 99)
    unknown = [s for s, k in held if k == len(S.FAMILIES)]
    known = [(s, S.FAMILIES[k]) for s, k in held if k < len(S.FAMILIES)]
    assert sum(S.judge(s)[0] is not None for s in unknown) <= 0.01 * len(unknown)
    assert sum(S.judge(s)[0] not in (k, None) for s, k in known) <= 0.03 * len(known)
