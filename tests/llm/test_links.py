"""All links of the n-gram join, and each document's number of them, against brute force."""

import pytest

from quern.llm import ngram_join


def linked(rows, k, percent):
    sets = {d: set(ngram_join.shingles(t, k).tolist()) for d, t in rows}
    ids = sorted(sets)
    return sets, {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def near_rows():
    from test_methods import near_rows as made

    rows = made(7, (5, 31, 60, 200))
    base = [f"g{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(base[: 100 - i % 4])) for i in range(30)]  # one group, most of it copies
    return rows + [(2000, ""), (2001, None), (2002, "one"), (2003, "ONE")]


@pytest.mark.parametrize("k,percent,block", [(3, 90, ngram_join.BLOCK), (3, 90, 2500), (5, 80, 3000)])
def test_every_link_is_found(spark, k, percent, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, want = linked(rows, k, percent)
    pairs, members = ngram_join.near_links(df, k, percent, block=block)
    rep = {r["doc_id"]: r["rep"] for r in members.collect()}
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert set(rep) == set(sets) and all(sets[d] == sets[r] for d, r in rep.items()) and all(rep[a] == a and rep[b] == b for a, b in got)
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if rep[a] == a and rep[b] == b}
    n = dict.fromkeys(sets, 0)
    for a, b in want:
        n[a] += 1
        n[b] += 1
    low = {d: d for d in sets}
    for _ in range(40):
        for a, b in want:
            low[a] = low[b] = min(low[a], low[b])
    counted = ngram_join.near_duplicates(df, k, percent, block=block).collect()
    assert {r["doc_id"]: r["n_links"] for r in counted} == n and {r["doc_id"]: r["component_id"] for r in counted} == low
    assert max(n.values()) >= 29
