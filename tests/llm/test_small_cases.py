"""Nulls, empty and very long texts, ties and repeated rows, empty tables and further columns: each operator's defined results."""

import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, license_scan, mixing, ngram_join, pieces, pii, quality_classifier, quality_rules, secret_scan, url_filter
from quern.llm.queries import PIECE_MODEL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, size string, keep string, u string, block string, fp string"
LONG = " ".join(f"word{i % 5000}" for i in range(30_000))
ROWS = [
    (1, "Hello World", "en", "a"), (2, "hello world", "en", "b"), (2, "hello world", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, " \n\t ", "en", None),
    (None, "no id here", "en", "a"), (None, None, None, "b"), (6, LONG, "en", "a"), (7, LONG + " end", "en", "b"), (8, "É ß 😀 ￿", "xx", "c"), (9, "hello worlD", None, "c"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "x", 1, "s", "k", "u", "b", "f") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, 0), (6, 1), (7, 1), (None, 1), (9, None)], "doc_id long, quality int")


def both(docs, run):
    """The rows over the small table; the empty one must not fail either."""
    assert run(docs.limit(0)).count() == 0
    return run(docs).collect()


def test_ngram_join(docs):
    got = both(docs, lambda d: ngram_join.near_duplicates(d, 3, 90))
    assert len(got) == N
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    assert by[1] == by[2] == by[9] == {(1, 1)} and by[3] == {(0, 3)} and by[4] == {(0, 4)} and by[5] == {(0, 5)}
    assert by[6] == {(5000, 6)} and by[7] == {(5001, 6)} and by[8] == {(2, 8)} and by[None] == {(1, None), (0, None)}
    assert sorted(r["doc_id"] or 0 for r in ngram_join.drop_near_copies(docs).collect()) == [0, 0, 1, 3, 4, 5, 6, 8]


def test_pieces(docs):
    got = both(docs, lambda d: pieces.encode(d, pieces.read_model(PIECE_MODEL)))
    assert len(got) == N and all(r["round_trip"] for r in got) and {r["n_pieces"] for r in got if r["doc_id"] in (3, 4)} == {0}


def test_quality_rules(docs):
    got = both(docs, lambda d: quality_rules.apply_policy(quality_rules.ledger(d)))
    assert len(got) == N
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert by[3]["n_words"] == by[5]["n_words"] == 0 and by[3]["base_failed"] and by[6]["n_repeat_words"] == 30_000 and by[8]["word_chars"] == 4
    assert quality_rules.ablate(quality_rules.ledger(docs)).where("rule = 'too_few_words'").first()["n_failed"] == N - 2


def test_pii_and_secrets(docs):
    for run in (lambda d: pii.digest(pii.find(d)), lambda d: secret_scan.digest(secret_scan.scan(d, increments=2))):
        got = both(docs, run)
        assert len(got) == N and {r["spans"] for r in got} == {""}


def test_licences(docs):
    got = both(docs, lambda d: license_scan.digest(license_scan.scan(d)))
    assert len(got) == N and {r["n_licences"] for r in got} == {0} and {r["n_paragraphs"] for r in got if r["doc_id"] in (3, 4, 5)} == {0}


def test_exact_dedup(docs):
    got = both(docs, exact_dedup.exact_groups)
    assert len(got) == N
    by = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"]}
    assert by[1] == by[2] == (9, 4, False) and by[9] == (9, 4, True) and by[3] == (4, 3, False) and by[4] == (4, 3, True) and by[6] == (6, 1, True)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 4, 5, 6, 7, 8, 9]
    again = docs.where("doc_id = 2")
    assert again.count() == 2 and exact_dedup.drop_copies(again).count() == 1


def test_quality_classifier(docs, labels):
    got = both(docs, lambda d: quality_classifier.classify(d, labels))
    assert len(got) == N and all(0 <= r["score"] <= 1 for r in got) and {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert quality_classifier.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_mixing(docs):
    got = both(docs, mixing.mix)
    assert len(got) == N and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    taken = sum(r["taken"] for r in got)
    assert out.select(F.sum(mixing.word_count(F.coalesce("text", F.lit(""))))).first()[0] == taken


def test_url_filter(spark):
    d = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (None, "http://EXAMPLE.org?x", "h"), (4, "ftp://a.b.com/fr/x#y", "p"), (4, "ftp://a.b.com/fr/x#y", "p"), (5, "https://x.net/porn", ""), (6, "https://x.net/pornx/casino-poker", ""), (7, "x://y/casino/casino", "")], "page_id long, url string, host string")
    assert url_filter.filter_urls(d.limit(0)).count() == 0
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(d).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "example.org", "", None, "allow"), (4, "a.b.com", "/fr/x", "com/fr/", "allow"), (5, "x.net", "/porn", None, "block"), (6, "x.net", "/pornx/casino-poker", None, "block"), (7, "y", "/casino/casino", None, "allow")}
