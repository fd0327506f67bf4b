import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import scalar
from quern.functions import text as X
from quern.operators import constraints as C
from quern.operators import graph as G
from quern.operators import logs as L
from quern.operators import partitioning as P
from quern.operators import relational as R
from quern.operators import simulate as S
from quern.operators import spatial as Z
from quern.operators import tenants as N
from quern.operators import vectors as V
from quern.operators import versions as W
from quern.operators.documents import Collection, WriteError
from quern.plans import advisor as A
from quern.plans import explain as E
from quern.queries.data import WAL, wal
from quern.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# ---- relational


def test_pipeline_and_reopen(spark):
    d = R.from_columns(spark, {"id": list(range(17)), "amount": [10 * i for i in range(17)]}, 4)
    out = R.project(R.where(d, R.compare("amount", ">=", 80)), ["id"])
    assert [r["id"] for r in out.collect()] == list(range(8, 17)) == [r["id"] for r in out.collect()]


def test_guards(spark):
    d = R.from_rows(spark, [{"a": 1}], "a int")
    for bad in (lambda: R.limit(d, -1), lambda: R.limit(d, True), lambda: R.compare("a", "~", 1), lambda: R.from_columns(spark, {"a": [1], "b": []}), lambda: R.from_columns(spark, {"a": [1]}, 0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        R.project(d, ["z"])
    with pytest.raises(Exception, match="BOOLEAN"):
        R.where(d, F.col("a") + 1).collect()
    assert R.limit(d, 0).count() == 0


@pytest.mark.parametrize("left,right", [([], []), ([1, 1], [1, 1, 2]), ([-1, 255], [255, -1]), ([3, -4, 3], [3, 3, -4, 9])])
def test_join_pairs(spark, left, right):
    a = spark.createDataFrame(list(enumerate(left)), "i long, k long")
    b = spark.createDataFrame(list(enumerate(right)), "j long, k long")
    assert rows(R.join_pairs(a, b, "k", "i", "j")) == sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x == y)
    assert R.hash_join(a, b, "k", build="right").count() == sum(x == y for x in left for y in right)


def test_bound_parameters_and_roles(spark):
    spark.createDataFrame([("Amina", 1)], "name string, id int").createOrReplaceTempView("people")
    assert R.bound_sql(spark, "SELECT id FROM people WHERE name = :n", {"n": "x' OR '1'='1"}).count() == 0
    assert R.bound_sql(spark, "SELECT id FROM people WHERE name = :n", {"n": "Amina"}).first()["id"] == 1
    R.authorize("writer", "write")
    for role, what in (("reader", "write"), ("nobody", "read")):
        with pytest.raises(PermissionError):
            R.authorize(role, what)


def test_average(spark):
    d = spark.createDataFrame([(2.0,), (3.0,), (4.0,)], "gpa double")
    assert [R.average(d, "gpa", m).first()[0] for m in (3, 5)] == [3.5, None]
    assert R.average(d.limit(0), "gpa").first()[0] is None


def test_pushdown_and_pruning(spark, tmp_path):
    files.write(spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.col("id").cast("string").alias("s")), str(tmp_path / "t"), sort_by=("id",))
    d = spark.read.parquet(str(tmp_path / "t")).where("id between 10 and 20").select("g")
    (scan,) = E.scans(d)
    assert "GreaterThanOrEqual(id,10)" in scan["pushed"] and "s:" not in scan["schema"]
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path), "csv")


def test_observed_rows(spark):
    d, o = E.counted(spark.range(12))
    d.collect()
    assert o.get["rows"] == 12 and E.operators(spark.range(5).where("id > 2"))


# ---- constraints


def test_violations(spark):
    d = spark.createDataFrame([(1, -1, "a"), (2, None, "a"), (3, 4, "b")], "id int, q int, u string")
    other = spark.createDataFrame([("a",)], "code string")
    got = rows(C.violations(d, ["id"], {"q": F.col("q") > 0}, ("q",), (("u",),), {"u": (other, "code")}))
    assert got == [(1, "check:q"), (1, "unique:u"), (2, "not_null:q"), (2, "unique:u"), (3, "foreign:u")]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string")
    assert rows(C.insert_ignore(t, n, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(C.upsert(t, n, ["k"])) == [(1, "a"), (2, "z"), (3, "c")]
    acc = spark.createDataFrame([(1, 1000, 1), (2, 1000, 1)], "id int, balance int, version int")
    w = spark.createDataFrame([(1, 1, 900), (1, 1, 950), (2, 7, 0)], "id int, expected int, new int")
    assert rows(C.compare_and_set(acc, w, "id", "balance")) == [(1, 900, 2, True), (2, 1000, 1, False)]


def test_stock_is_never_oversold(spark):
    stock = spark.createDataFrame([("ST-004", 8), ("HD-003", 5)], "item string, have int")
    req = spark.createDataFrame([(1, "ST-004", 10), (2, "HD-003", 3), (3, "HD-003", 2), (4, "HD-003", 1), (5, "NONE", 1)], "id int, item string, want int")
    assert [r["accepted"] for r in C.reserve(stock, req, "item", "have", "want", ["id"]).orderBy("id").collect()] == [False, True, True, False, False]


def test_a_refused_request_leaves_the_stock(spark):
    rng = np.random.default_rng(4)
    stock = {f"i{k}": int(rng.integers(0, 40)) for k in range(7)}
    req = [(k, f"i{int(rng.integers(0, 8))}", int(rng.integers(1, 15))) for k in range(300)]
    left, want = dict(stock), []
    for _, i, n in req:
        want.append(n <= left.get(i, 0))
        left[i] = left.get(i, 0) - n * want[-1]
    r = spark.createDataFrame(req, "id int, item string, want int").repartition(5)
    got = C.reserve(spark.createDataFrame(list(stock.items()), "item string, have int"), r, "item", "have", "want", ["id"]).orderBy("id").collect()
    assert [x["accepted"] for x in got] == want and any(not a and b for a, b in zip(want, want[1:]))


def test_audit_diff(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (4, "same")], "id int, v string")
    b = spark.createDataFrame([(2, "z"), (3, "n"), (4, "same")], "id int, v string")
    got = {r["id"]: (r["operation"], r["old_row"], r["new_row"]) for r in C.audit_diff(a, b, "id").collect()}
    assert got == {1: ("DELETE", '{"id":1,"v":"x"}', None), 2: ("UPDATE", '{"id":2,"v":"y"}', '{"id":2,"v":"z"}'), 3: ("INSERT", None, '{"id":3,"v":"n"}')}


# ---- versions


def test_snapshots_and_conflicts(spark):
    v = spark.createDataFrame([("A", 100, 0), ("B", 50, 0), ("A", 80, 1)], "key string, value int, commit_seq int")
    assert rows(W.as_of(v, 0).select("key", "value")) == [("A", 100), ("B", 50)]
    assert rows(W.as_of(v, 1).select("key", "value")) == [("A", 80), ("B", 50)]
    reads = spark.createDataFrame([("A", 0), ("A", 1), ("A", -1), ("C", 5)], "key string, snapshot int")
    assert sorted(map(tuple, W.as_of_each(reads, v).collect()), key=str) == [("A", -1, None), ("A", 0, 100), ("A", 1, 80), ("C", 5, None)]
    w = spark.createDataFrame([("A", 0), ("B", 0), ("A", 1)], "key string, snapshot int")
    assert rows(W.write_conflicts(w, v)) == [("A", 0)]


def test_key_value_log(spark):
    log = spark.createDataFrame([(0, "a", "1", None, False), (1, "a", "2", None, False), (2, "s", "x", 10, False), (3, "gone", "0", None, False), (4, "gone", None, None, True)], "offset int, key string, value string, expires_at int, tombstone boolean")
    assert rows(W.live(log, 10).select("key", "value")) == [("a", "2")]
    assert rows(W.live(log, 9).select("key", "value")) == [("a", "2"), ("s", "x")]
    assert tuple(W.compaction(log, 10).first()) == (5, 1)


def test_newest_wins_against_a_dict(spark):
    rng = np.random.default_rng(7)
    ops = [(i, int(rng.integers(400)), None if rng.random() < 0.2 else f"v{i}") for i in range(4000)]
    model = {}
    for _, k, v in ops:
        model[k] = v
    d = spark.createDataFrame(ops, "seq int, k int, v string").repartition(7)
    got = W.range_scan(d, "k", 100, 110, ["seq"], F.col("v").isNull()).select("k", "v").collect()
    assert [tuple(r) for r in got] == [(k, model[k]) for k in sorted(model) if 100 <= k <= 110 and model[k] is not None]


def test_last_writer(spark):
    w = spark.createDataFrame([("x", "A", 1, 0, "all"), ("x", "A", 3, 1, "left"), ("x", "C", 2, 2, "right"), ("y", "A", 5, 3, "left"), ("y", "B", 5, 4, "right")], "key string, node string, ts int, value int, side string")
    assert rows(W.last_writer(w).select("key", "value")) == [("x", 1), ("y", 4)]
    assert rows(W.lost_writes(w.where("side <> 'all'")).select("key", "side")) == [("x", "right"), ("y", "left")]


def test_wide_column(spark):
    d = spark.createDataFrame([("c1", t, f"m{t}") for t in (5, 1, 3, 4, 2)] + [("c2", 1, "o")], "chat string, ts int, text string")
    assert [r["ts"] for r in W.select_partition(d, {"chat": "c1"}, ["ts"], (2,), (4,)).collect()] == [2, 3, 4]
    assert [r["ts"] for r in W.select_partition(d, {"chat": "c1"}, ["ts"], descending=True, limit=2).collect()] == [5, 4]
    with pytest.raises(W.QueryError):
        W.select_where(d, F.col("text") == "o")
    m = spark.createDataFrame([("k", 1, "a", None), ("k", 2, None, "b")], "k string, t int, x string, y string")
    assert rows(W.merge_columns(m, ["k"], ["t"])) == [("k", "a", "b")]


# ---- vectors


def test_metrics(spark):
    d = spark.createDataFrame([(0, [1.0, 0.1]), (1, [10.0, 9.0]), (2, [0.2, 1.0])], "vec_id int, embedding array<float>")
    assert [V.knn(d, [1.0, 0.0], 1, m).first()["vec_id"] for m in ("cosine", "dot", "l2")] == [0, 1, 0]
    assert V.knn(d, [1.0, 0.0], 9).count() == 3
    for bad in (lambda: V.knn(d, [1.0, 0.0], 1, "x"), lambda: V.knn(d, [0.0, 0.0], 1), lambda: V.unit(np.zeros(3))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="direction"):
        d.select(scalar.normalize(F.transform("embedding", lambda x: x * 0))).collect()


def test_search_agrees(spark):
    d = V.clustered(spark, 800, 16, 20).cache()
    qs = {r["vec_id"]: list(map(float, r["embedding"])) for r in d.where("vec_id % 40 = 0").collect()}
    exact = V.knn_batch(d, qs, 10).cache()
    one = next(iter(qs))
    assert [r["vec_id"] for r in V.knn(d, qs[one], 10).collect()] == [r["vec_id"] for r in exact.where(F.col("qid") == one).orderBy("rank").collect()]
    lists = V.InvertedLists(16, 5).build(d)
    mean = lambda found: V.recall(found, exact).agg(F.avg("recall")).first()[0]
    assert mean(lists.search(qs, 10, 16)) == 1.0
    assert mean(lists.search(qs, 10, 4)) > 0.6
    assert mean(V.graph_search(d, qs, 10, partitions=2)) > 0.95


# ---- text

MD = "# Logs\n" + "The log is flushed before the page is written to disk because recovery needs it. " * 3 + "\n```\ncode here\n```\n## Table\n| name | size |\n|---|---|\n| lru | big |\n" + "More words follow here so that the section is long enough to keep.\n# Short\nfew words\n"


def test_markdown(spark):
    files = spark.createDataFrame([("lab", MD), ("s", "# A\n" + " ".join(f"w{i}" for i in range(300))), ("none", None)], "path string, text string")
    got = {}
    for r in X.chunks(files).collect():
        got.setdefault(r["source"], []).append((r["heading"], r["text"]))
    lab = dict(got["lab"])
    assert set(lab) == {"Logs", "Table"} and "code here" not in lab["Logs"] and "name: lru; size: big." in lab["Table"] and "none" not in got
    long = sorted((t for _, t in got["s"]), key=lambda t: int(t.split()[0][1:]))
    assert [t.split()[0] for t in long] == ["w0", "w90", "w180"] and long[0].split()[-30:] == long[1].split()[:30]


def test_retrieval(spark):
    docs = [(1, "recovery-notes", "Recovery", "The write ahead log must be flushed before a dirty page is written to disk so that undo is possible."), (2, "cluster-notes", "Raft", "A leader is elected by a majority of the votes of the cluster in each new term."), (3, "cluster-notes", "Vectors", "An index of neighbours walks greedily down the layers of a navigable graph to search.")]
    r = X.Retrieval(spark.createDataFrame(docs, "id long, source string, heading string, text string"))
    assert r.retrieve("Why must the log be flushed before a dirty page is written?", 1).first()["id"] == 1
    a = r.answer("Who is elected leader of the cluster by votes?").first()
    assert a["grounded"] and a["text"].startswith("A leader is elected") and "[1] cluster-notes / Raft" in a["citations"][0]
    assert not r.answer("zebra quagga xylophone").first()["grounded"] and r.retrieve("zebra").count() == 0
    with pytest.raises(ValueError):
        X.Retrieval(r.table.limit(0))


# ---- partitions


def test_ranges(spark):
    p = P.Ranges((100, 200), ("a", "b", "c"))
    d = spark.createDataFrame([(k,) for k in (0, 99, 100, 199, 200)], "k int")
    assert [r[0] for r in d.select(p.shard(F.col("k"))).collect()] == ["a", "a", "b", "b", "c"]
    assert p.touching(50, 150) == ["a", "b"] and p.touching(100, 100) == ["b"] and p.touching(-5, 900) == ["a", "b", "c"]
    wider = p.cut("b", 150, "d")
    assert wider.names == ("a", "b", "d", "c") and wider.touching(149, 150) == ["b", "d"] and p.cut("a", 7, "z").names == ("a", "z", "b", "c")
    with pytest.raises(ValueError):
        p.cut("a", 150, "d")
    with pytest.raises(ValueError):
        P.Ranges((2, 1), ("a", "b", "c"))
    assert P.target({"$and": [{"k": 150}, {"x": 1}]}, "k", p) == ["b"] and P.target({"k": {"$gt": 1}}, "k", p) == ["a", "b", "c"]


@pytest.mark.parametrize("exact", [False, True])
def test_ring(spark, exact):
    import bisect

    ring = P.Ring(["n1", "n2", "n3", "n4"], 50, exact)
    got = ring.place(spark.range(300), "id", 3).collect()
    points, h = sorted(ring.owner), P._blake if exact else P._md5
    for r in got:
        i, want = bisect.bisect_left(points, h(str(r["id"]))), []
        while len(want) < 3:
            n = ring.owner[points[i % len(points)]]
            want += [] if n in want else [n]
            i += 1
        assert r["replicas"] == want
    before = ring.place(spark.range(2000), "id").select("id", F.col("replicas")[0].alias("x"))
    after = ring.add("n5").place(spark.range(2000), "id").select("id", F.col("replicas")[0].alias("y"))
    assert 0.05 < P.moved(before.join(after, "id"), "x", "y").first()[0] < 0.4
    with pytest.raises(ValueError):
        ring.place(spark.range(1), "id", 5)


# ---- graphs and space


def test_graph(spark):
    nodes = spark.createDataFrame([("a", "Cairo"), ("c", "Cairo"), ("e", "Cairo"), ("b", "Giza"), ("d", "Giza")], "id string, label string")
    e = spark.createDataFrame([(x[0], x[1], "FOLLOWS") for x in ("ab", "bc", "cd", "ae", "ec")], "src string, dst string, type string")
    assert G.shortest_path(e, "a", "d")[0::3] == ["a", "d"] and len(G.shortest_path(e, "a", "d")) == 4
    far = spark.range(70).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert G.shortest_path(far, 0, 60) == list(range(61))
    assert G.shortest_path(e, "d", "a") is None and G.shortest_path(e, "a", "a") == ["a"]
    assert rows(G.suggestions(e).where("id = 'a'")) == [("a", "c")]
    assert rows(G.match(nodes, e, "Cairo", "FOLLOWS", "Cairo")) == [("a", "e"), ("e", "c")]
    assert G.check_edges(nodes, e.unionByName(spark.createDataFrame([("a", "zz", "FOLLOWS")], e.schema))).count() == 1


@pytest.mark.parametrize("edges,want", [([(1, 2), (2, 3)], []), ([(1, 2), (2, 1)], [1, 2]), ([(1, 2), (2, 3), (3, 1), (3, 4)], [1, 2, 3]), ([(7, 7)], [7])])
def test_cycles(spark, edges, want):
    d = spark.createDataFrame(edges, "src long, dst long")
    assert [r[0] for r in rows(G.cycle_nodes(d))] == want
    d.createOrReplaceTempView("edges")
    assert [r[0] for r in rows(G.reachable(spark).where("src = dst").select("src").distinct())] == want


def test_space(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(25, 35, 500), rng.uniform(22, 32, 500)))]
    d = Z.rect(spark.createDataFrame(pts, "id int, x double, y double"))
    assert [r[0] for r in rows(Z.window(d, 26, 23, 28, 25).select("id"))] == [i for i, x, y in pts if 26 <= x <= 28 and 23 <= y <= 25]
    assert [r["id"] for r in Z.nearest(d, 30, 27, 5).collect()] == [i for _, i in sorted((math.hypot(x - 30, y - 27), i) for i, x, y in pts)[:5]]
    one = spark.createDataFrame([(1, 26.0, 23.0, 28.0, 25.0)], "id int, xmin double, ymin double, xmax double, ymax double")
    assert Z.window(one, 27, 24, 27.1, 24.1).count() == 1 and Z.window(one, 28, 25, 30, 30).count() == 1 and Z.window(one, 28.1, 25, 30, 30).count() == 0
    w = spark.createDataFrame([(k, 25.0 + k, 22.0 + k, 27.5 + k, 23.5 + k) for k in range(5)], "wid int, xmin double, ymin double, xmax double, ymax double")
    assert rows(Z.join_windows(d, w, 0.7)) == sorted((k, i) for k in range(5) for i, x, y in pts if 25 + k <= x <= 27.5 + k and 22 + k <= y <= 23.5 + k)


# ---- advisor

EQ = A.TableStats(10_000, 200, {"status": A.ColumnStats(0.05, 12, {"hot": 0.60, "warm": 0.20})}, frozenset({"status"}))
RANGE = A.ColumnStats(0.10, 10, {10: 0.20, 90: 0.10}, (0, 25, 50, 75, 100))


def test_equality_costs():
    cost = lambda v: {p.kind: (p.estimated_rows, round(p.estimated_cost, 6)) for p in A.candidates(EQ, [A.Predicate("status", "=", v)])}
    assert cost("rare") == {"SeqScan": (150, 300.0), "IndexScan": (150, 229.8)}
    assert cost("hot") == {"SeqScan": (6000, 300.0), "IndexScan": (6000, 375.0)} or cost("hot")["SeqScan"] == (6000, 300.0)
    assert A.recommend(EQ, [A.Predicate("status", "=", "rare")]).kind == "IndexScan" and A.recommend(EQ, [A.Predicate("status", "=", "hot")]).kind == "SeqScan"
    assert A.equality(None, 1) == 0.10 and A.equality(EQ.columns["status"], None) == 0.0 and A.recommend(EQ, []).estimated_rows == 10_000


@pytest.mark.parametrize("op,value,want", [("<=", 20, 0.32), ("<", 10, 0.06), ("<", 0, 0.0), (">", 100, 0.0), ("<", 30, None)])
def test_ranges_selectivity(op, value, want):
    got = A.selectivity(RANGE, op, value)
    if want is None:
        assert got + A.selectivity(RANGE, ">=", value) == pytest.approx(0.9)
    else:
        assert got == pytest.approx(want)


def test_conjunctions():
    t = A.TableStats(1000, 50, {"a": RANGE, "b": A.ColumnStats(0, 2, {"x": 0.8})})
    s = lambda *ps: A.conjunction(t, [A.Predicate(*p) for p in ps])
    assert s(("a", "=", 10), ("b", "=", "x")) == pytest.approx(0.16)
    assert s(("a", "=", 10), ("a", "=", 90)) == 0 and s(("a", "=", 10), ("a", "<", 5)) == 0 and s(("a", "=", 10), ("a", "=", 10)) == pytest.approx(0.2)
    assert s(("a", ">", 50), ("a", "<", 20)) == 0 and s(("a", ">=", 10), ("a", "<=", 10)) == pytest.approx(0.2) and s(("a", ">", 10), ("a", "<=", 10)) == 0
    assert s(("a", ">=", 25), ("a", "<", 50)) == pytest.approx(0.15) and s() == 1
    for bad in ((("z", "=", 1),), (("a", "<", "x"),), (("a", "!", 1),), (("b", "<", 3),)):
        with pytest.raises(ValueError):
            s(*bad)


@pytest.mark.parametrize("args", [(-0.1, 1), (0.5, -1), (0.5, 2, {1: 0.6}), (0, 5, {None: 0.1}), (0, 1, {1: 0.1, 2: 0.1}), (0, 5, {}, (1, 1)), (float("nan"), 1), (True, 1)])
def test_bad_statistics(args):
    with pytest.raises(ValueError):
        A.ColumnStats(*args)


def test_collected_statistics(spark):
    d = spark.createDataFrame([("hot" if i < 60 else "warm" if i < 80 else None if i < 85 else f"r{i}", i) for i in range(100)], "s string, n int")
    got = {r["column"]: r for r in A.collect_stats(d, ["s", "n"], mcv=2, bins=4).collect()}
    assert got["s"]["null_frac"] == 0.05 and got["s"]["n_distinct"] == 17 and got["s"]["most_common"] == {"hot": 0.6, "warm": 0.2}
    assert list(got["n"]["histogram_bounds"]) == [0, 24.75, 49.5, 74.25, 99]
    assert A.table_stats(A.collect_stats(d, ["s"], 2), 4).columns["s"].most_common == {"hot": 0.6, "warm": 0.2}


# ---- logs


def test_recovery(spark):
    log = wal(spark)
    assert L.undo_chain(log, 1) == [12, 4] and L.undo_chain(log, 3) == [13, 6]
    for bad in (2, 9):
        with pytest.raises(ValueError):
            L.undo_chain(log, bad)
    part = wal(spark, [*WAL[:6], (7, "UPDATE", 1, 4, "B", 1, 2, None), (8, "UPDATE", 1, 7, "C", 1, 2, None), (9, "CLR", 1, 8, "C", None, 1, 7)])
    assert L.undo_chain(part, 1) == [7, 4]
    twice = wal(spark, [(1, "BEGIN", 1, None, None, None, None, None), (2, "UPDATE", 1, 1, "A", 0, 1, None), (3, "UPDATE", 1, 2, "B", 0, 1, None), (4, "CLR", 1, 3, "B", None, 0, 2), (5, "UPDATE", 1, 4, "C", 0, 1, None), (6, "UPDATE", 1, 5, "D", 0, 1, None), (7, "CLR", 1, 6, "D", None, 0, 5)])
    assert L.undo_chain(twice, 1) == [5, 2]
    assert L.redo_decision("UPDATE", 6, "C", {"A": 4}, 0) == "not in DPT" and L.redo_decision("CLR", 6, "C", {"C": 7}, 0) == "LSN < recLSN"
    assert L.redo_decision("UPDATE", 6, "C", {"C": 6}, 6) == "pageLSN >= LSN" and L.redo_decision("UPDATE", 6, "C", {"C": 6}, 5) == "apply"
    with pytest.raises(ValueError):
        L.redo_decision("COMMIT", 6, "C", {}, 0)
    assert L.truncation_point(log, 7) == 1


@pytest.mark.parametrize("lsn,want", [(30, ([3, 4], 8.0)), (51, ([4], 2.5)), (52, ([], 0.0)), (5, ([1, 2, 3, 4], 12.0))])
def test_failover(spark, lsn, want):
    c = spark.createDataFrame([(1, 10, 0.0), (2, 25, 4.0), (3, 40, 9.5), (4, 52, 12.0)], "tx_id int, commit_lsn int, commit_time double")
    assert tuple(L.failover_loss(c, lsn).first()) == want


def test_audit_chain(spark):
    events = spark.createDataFrame([(log, i, f"sara{i}") for log in ("a", "b") for i in range(1, 6)], "log string, seq long, user string").repartition(3)
    sealed = L.seal(events, "log", "seq", F.to_json(F.struct("seq", "user"))).cache()
    damage = lambda d: {r["log"]: r["first_damaged"] for r in L.first_damaged(d, "log").collect()}
    assert damage(sealed) == {"a": None, "b": None}
    assert damage(sealed.where("not (log = 'a' and seq = 3)")) == {"a": 4, "b": None}
    forged = sealed.withColumn("body", F.when(F.expr("log = 'b' and seq = 2"), F.regexp_replace("body", "sara", "omar")).otherwise(F.col("body")))
    assert damage(forged) == {"a": None, "b": 2}


# ---- simulators and tenants


def test_cache(spark):
    c = S.Cache("lru", 3)
    for p in (0, 1, 2, 0, 3, 1):
        c.access(p)
    assert (c.hits, c.misses) == (1, 5)
    got = S.lru_hits(spark.createDataFrame(list(enumerate([0, 1, 2, 0, 3, 1])), "pos int, page int"), 3)
    assert [r["hit"] for r in got.orderBy("pos").collect()] == [False, False, False, True, False, False]
    ratio = {p: S.Cache(p, 4) for p in S.POLICIES}
    for p, cache in ratio.items():
        for page in [0, 1, 0, 1, 10, 11, 12, 0, 1]:
            cache.access(page)
    assert ratio["lru2"].hits == ratio["2q"].hits == 4 and ratio["lru"].hits == 2
    pinned = S.Cache("lru", 1)
    pinned.access(1, pin=True)
    with pytest.raises(RuntimeError):
        pinned.access(2)


def test_elections_end(spark):
    r = {(x["low"], x["high"]): x["mean_ticks"] for x in S.split_votes(spark, 30).collect()}
    assert len(r) == 3 and all(150 <= t < 20_000 for t in r.values()) and r[150, 160] > r[150, 300]


def test_tenants(spark):
    d = spark.createDataFrame([(f"t{i}", "acme" if i < 6 else "globex", i % 3) for i in range(10)], "_id string, tenant string, priority int")
    s = N.Session({"tickets": Collection(d)}, "acme")
    assert s.count("tickets") == 6 and s.count("tickets", {"tenant": "globex"}) == 0
    assert s.delete("tickets", {}) == 6 and s.all["tickets"].count_documents() == 4
    s.insert("tickets", [{"_id": "n1", "priority": 1}])
    assert s.count("tickets") == 1
    for bad in (lambda: s.insert("tickets", [{"tenant": "globex"}]), lambda: s.update("tickets", {}, {"$set": {"tenant": "globex"}})):
        with pytest.raises(WriteError):
            bad()


def test_transfers_keep_the_total(spark):
    a = spark.createDataFrame([("alice", 100), ("bob", 40), ("carol", 50)], "account string, balance int")
    m = spark.createDataFrame([(1, "alice", "carol", 30), (2, "bob", "alice", 10), (3, "bob", "dave", 1), (4, "bob", "zed", 500)], "tx int, src string, dst string, amount int")
    out, after = N.transfers(a, m)
    assert rows(out) == [(1, "COMMIT"), (2, "ABORT"), (3, "ABORT"), (4, "ABORT")]
    assert rows(after) == [("alice", 70), ("bob", 40), ("carol", 80)]
    kept = []
    bad = N.all_or_nothing(a, after, {"positive": F.col("balance") > 60}, kept.append)
    assert bad.count() == 1 and not kept


# ---- sources and streams


def test_objects(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    f = files.objects(spark, str(tmp_path))
    m = files.manifest(f, "docs")
    assert {r["file_name"]: (r["content_type"], r["size_bytes"]) for r in m.collect()} == {"a.txt": ("text/plain", 5), "b.bin": ("application/octet-stream", 2)}
    m = spark.createDataFrame(m.collect(), m.schema)
    (tmp_path / "b.bin").write_bytes(b"\x00\x02")
    f = files.objects(spark, str(tmp_path))
    assert {r["file_name"]: r["intact"] for r in files.verified(m, f).collect()} == {"a.txt": True, "b.bin": False}
    (tmp_path / "c.txt").write_bytes(b"lost")
    assert files.orphans(m, files.objects(spark, str(tmp_path))).count() == 1
    assert files.corpus(spark, str(tmp_path / "*.txt")).count() == 2


def test_encryption(spark):
    key = "00" * 32
    d = spark.range(3).select("id", F.lit("page" * 1024).cast("binary").alias("p"))
    e = d.select("id", "p", files.encrypted(F.col("p"), F.col("id"), key).alias("e")).cache()
    assert e.where(F.length("e") != 4096 + 28).count() == 0
    assert e.where(files.decrypted(F.col("e"), F.col("id"), key) == F.col("p")).count() == 3
    assert e.where(files.decrypted(F.col("e"), F.col("id") + 1, key).isNotNull()).count() == 0


def test_streams(spark, tmp_path):
    from quern.streaming import views

    src, schema = str(tmp_path / "in"), "id long, k string, v long, ts timestamp, dead boolean"
    spark.createDataFrame([(1, "a", 1, None, False), (2, "b", 1, None, False), (3, "a", 2, None, False)], schema).write.parquet(src)
    go = lambda: views.keep_newest(views.tail(spark, src, schema), str(tmp_path / "t"), str(tmp_path / "cp"), ["k"], ["id"]).awaitTermination()
    go()
    assert rows(views.current(spark, str(tmp_path / "t")).select("k", "v")) == [("a", 2), ("b", 1)]
    spark.createDataFrame([(4, "b", 9, None, True)], schema).write.mode("append").parquet(src)
    go()
    assert rows(views.current(spark, str(tmp_path / "t"), deleted="dead").select("k", "v")) == [("a", 2)]
    times = [(i, "x", 1, f"2024-01-01 0{h}:10:00") for i, h in enumerate((1, 1, 2, 5))]
    spark.createDataFrame(times, "id long, k string, v long, t string").select("id", "k", "v", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "w"))
    s = views.windowed(spark.readStream.schema("id long, k string, v long, ts timestamp").parquet(str(tmp_path / "w")), "ts", ["k"], value="v")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("select n from w order by start").collect()] == [2, 1, 1]
    u = views.once(spark.readStream.schema("id long, k string, v long, ts timestamp").parquet(str(tmp_path / "w")), "ts", ["k"])
    q = u.writeStream.format("memory").queryName("u").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from u").count() == 1
