"""Recall of the registered index searches, by the query that measures them."""

import pytest

from quern.queries import every


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_recall(spark, sf):
    got = {r["query"]: r["recall"] for r in every()[0]["ag20_index_recall"](spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == {"sl11_inverted_lists", "sl12_graph_index"} and min(got.values()) >= 0.9
