"""The default vocabulary of op3 decides urls that no rule fits."""

from quern.llm import url_filter


def test_one_clear_term_rejects(spark):
    bad = ["http://royal-casino-poker.example.net/a", "http://m.pills-now.example.net/", "https://spam.example.net/x", "http://best-bets.example.net/", "http://a.net/online-gambling"]
    good = ["http://a.net/adult-education", "http://a.net/royalty", "http://spamalot.example.net/", "http://pillsbury.example.net/", "http://sussex.example.net/", "http://alphabets.example.net/"]
    d = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(d).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)
    assert not set(url_filter.STRICT) & set(url_filter.SOFT)
