"""Further rows of the inventory: storage layouts, document expressions, functions, writes, procedures, plans."""

import tempfile

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions import text as X
from ..operators import constraints as C
from ..operators import documents as D
from ..operators import partitioning as P
from ..operators import relational as R
from ..operators import simulate as S
from ..operators import spatial as Z
from ..operators import tenants as N
from ..operators import versions as W
from ..plans import advisor as A
from ..session import register
from ..session import table as _t
from ..sources import files
from ..sources.scratch import Scratch
from . import Theme
from .data import _chunks, _coll, _orders, _points, _query, _questions

q = Theme()


@q("sc2_columns_to_frame", "SELECT i AS id, i * 10 AS amount FROM range(17) t(i) WHERE i * 10 >= 80")
def sc2(spark, d):
    return R.where(R.from_columns(spark, {"id": list(range(17)), "amount": [10 * i for i in range(17)]}, 4), F.col("amount") >= 80)


@q("sc5_row_scan", "SELECT * FROM supplier")
def sc5(spark, d):
    return _t(spark, d, "supplier").select("*")


@q("sc8_row_from_columns", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey = 5")
def sc8(spark, d):
    return _t(spark, d, "supplier").where("s_suppkey = 5").select("s_suppkey", "s_name", "s_acctbal")


@q("sc9_rows_to_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def sc9(spark, d):
    """A row format written, read with its schema, and kept as columns."""
    tmp = Scratch(spark, "rows")
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    s.write.mode("overwrite").csv(f"{tmp.root}/csv")
    return tmp.save(files.read(spark, f"{tmp.root}/csv", "csv", "s_suppkey long, s_acctbal double"), "parquet")


@q("sc10_append", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def sc10(spark, d):
    tmp, n = Scratch(spark, "append"), _t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    n.write.parquet(f"{tmp.root}/t")
    n.where("n_regionkey = 1").write.mode("append").parquet(f"{tmp.root}/t")
    return spark.read.parquet(f"{tmp.root}/t").select("n_nationkey")


@q("sc12_sorted_point_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 777")
def sc12(spark, d):
    """Files sorted by key with Bloom filters: a lookup skips all row groups but one."""
    tmp = Scratch(spark, "sorted")
    files.write(_t(spark, d, "orders"), f"{tmp.root}/t", sort_by=("o_orderkey",), bloom=("o_orderkey",))
    return spark.read.parquet(f"{tmp.root}/t").where("o_orderkey = 777").select("o_orderkey", "o_totalprice")


@q("sc21_verified_objects", "SELECT 'a.txt' AS file_name, true AS intact UNION ALL SELECT 'b.txt', false")
def sc21(spark, d):
    from pathlib import Path

    from pyspark.sql import types as T

    with tempfile.TemporaryDirectory() as at:  # a local store of two small objects; one changes after its pointer was written
        for n in "ab":
            Path(at, f"{n}.txt").write_text(n)
        m = files.manifest(files.objects(spark, at), "docs")
        kept = spark.createDataFrame(m.collect(), m.schema)
        Path(at, "b.txt").write_text("changed")
        got = files.verified(kept, files.objects(spark, at)).select("file_name", "intact").collect()
    return spark.createDataFrame(got, T.StructType([T.StructField("file_name", T.StringType()), T.StructField("intact", T.BooleanType())]))


@q("sc22_joined_list", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY o_orderkey")
def sc22(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name").orderBy("o_orderkey")


@q("sc24_index_side_table", "SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_partkey IN (10, 20)")
def sc24(spark, d):
    """A secondary index as a table (key, _id), one row for each array element, read by key and semi-joined."""
    o = _orders(spark, d)
    index = o.select(F.explode(F.array_distinct(F.transform("items", lambda x: x["part"]))).alias("key"), "_id")
    return o.select("_id").join(index.where(F.col("key").isin(10, 20)).select("_id").distinct(), "_id", "left_semi")


@q("pf16_not", "SELECT o_orderkey AS _id FROM orders WHERE NOT (o_totalprice > 100000)")
def pf16(spark, d):
    return _coll(spark, d)["orders"].find({"total": {"$not": {"$gt": 100000}}}).select("_id")


@q("pf17_array_index", "SELECT l_orderkey AS _id FROM (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) WHERE p = 5")
def pf17(spark, d):
    return _coll(spark, d)["orders"].find({"items.0.part": 5}).select("_id")


@q("pf19_path_through_array", "SELECT l_orderkey AS _id, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units FROM lineitem GROUP BY 1")
def pf19(spark, d):
    p = _coll(spark, d)["orders"].aggregate([{"$match": {"items": {"$exists": True}}}, {"$project": {"qty": "$items.qty"}}])
    return p.select("_id", F.aggregate("qty", F.lit(0).cast("long"), lambda a, x: a + x).alias("units"))


@q("pf20_projection", "SELECT o_orderkey AS _id, o_custkey AS customer, o_totalprice AS total FROM orders")
def pf20(spark, d):
    return _coll(spark, d)["orders"].find({}, {"items": 0, "status": 0})


@q("pf24_intersects", "SELECT i AS id FROM range(20) t(i) WHERE i <= 9.5 AND i + 2 >= 4 AND i <= 8")
def pf24(spark, d):
    r = spark.range(20).select("id", F.col("id").cast("double").alias("xmin"), (F.col("id") + 2).cast("double").alias("xmax"), F.lit(0.0).alias("ymin"), F.col("id").cast("double").alias("ymax"))
    return Z.window(r, 4, 0, 8, 1).where("xmin <= 9.5").select("id")


@q("jn10_restricted_lookup", "SELECT o_orderkey AS _id, CAST(count(c_custkey) AS INT) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' GROUP BY 1")
def jn10(spark, d):
    a = _coll(spark, d)["orders"].aggregate([{"$lookup": {"from": "customers", "localField": "customer", "foreignField": "_id", "as": "c"}}], {"segment": "BUILDING"})
    return a.select("_id", F.size("c").alias("n"))


@q("jn9_lookup_through_array", "SELECT l_orderkey AS _id, CAST(count(DISTINCT l_partkey) AS INT) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def jn9_array(spark, d):
    db = _coll(spark, d)
    db["parts"] = D.Collection(_t(spark, d, "part").select(F.col("p_partkey").alias("_id"), F.array("p_partkey").alias("_seq")), db)
    a = db["orders"].aggregate([{"$match": {"items": {"$exists": True}}}, {"$lookup": {"from": "parts", "localField": "items.part", "foreignField": "_id", "as": "p"}}])
    return a.select("_id", F.size("p").alias("n"))


@q("jn15_range_boundaries", "SELECT c_custkey, CAST((c_acctbal >= 0)::INT + (c_acctbal >= 2500)::INT + (c_acctbal >= 7500)::INT AS VARCHAR) AS shard FROM customer")
def jn15(spark, d):
    return _t(spark, d, "customer").select("c_custkey", P.Ranges((0.0, 2500.0, 7500.0), ("0", "1", "2", "3")).shard(F.col("c_acctbal")).alias("shard"))


@q("ag11_push_and_set", "SELECT o_custkey AS _id, CAST(count(*) AS INT) AS pushed, CAST(count(DISTINCT o_orderstatus) AS INT) AS kinds FROM orders GROUP BY 1")
def ag11(spark, d):
    g = _coll(spark, d)["orders"].aggregate([{"$group": {"_id": "$customer", "all": {"$push": "$status"}, "set": {"$addToSet": "$status"}}}])
    return g.select("_id", F.size("all").alias("pushed"), F.size("set").alias("kinds"))


@q("ag12_first_last", "SELECT o_custkey AS _id, arg_min(o_orderkey, o_totalprice) AS low, arg_max(o_orderkey, o_totalprice) AS high FROM orders GROUP BY 1")
def ag12(spark, d):
    return _coll(spark, d)["orders"].aggregate([{"$sort": {"total": 1}}, {"$group": {"_id": "$customer", "low": {"$first": "$_id"}, "high": {"$last": "$_id"}}}])


@q("ag14_count_documents", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000")
def ag14(spark, d):
    return spark.createDataFrame([(_coll(spark, d)["orders"].count_documents({"status": "F", "total": {"$gte": 1000}}),)], "n long")


@q("ag17_hit_ratio", "SELECT CAST(1 AS DOUBLE) / 6 AS hit_ratio")
def ag17(spark, d):
    return S.lru_hits(spark.createDataFrame(list(enumerate([0, 1, 2, 0, 3, 1])), "pos int, page int"), 3).agg(F.avg(F.col("hit").cast("double")).alias("hit_ratio"))


@q("ag21_hit_at_k")
def ag21(spark, d):
    asked = _questions(spark, d, 10)
    found = X.Retrieval(_chunks(spark, d)).retrieve(asked).select(F.col("question_id").alias("question"), F.col("id").alias("source"))
    all_hits = X.hits(found, asked.select(F.col("question_id").alias("question"), F.col("question_id").alias("expected")))
    every = asked.select(F.col("question_id").alias("question")).join(all_hits, "question", "left")  # one without known words is no hit
    return every.select(F.col("question").cast("string").alias("question"), F.coalesce("hit", F.lit(False)).alias("hit"))


@q("ag25_tenant_counts", "SELECT o_orderstatus AS tenant, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def ag25(spark, d):
    return N.tickets(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("tenant"), F.col("o_orderpriority").alias("priority")))


@q("sl2_ordered", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sl2(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey")


@q("sl8_sql_knn", "SELECT vec_id FROM embeddings ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) DESC, vec_id LIMIT 5")
def sl8(spark, d):
    register(spark, d, "embeddings")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0)")
    return spark.sql("SELECT vec_id FROM (SELECT vec_id, round(cosine(cast(embedding AS array<double>), :q), 6) AS score FROM embeddings) ORDER BY score DESC, vec_id LIMIT 5", args={"q": F.array(*[F.lit(x) for x in _query(spark, d, 3)[3]])})


@q("sl14_answer")
def sl14(spark, d):
    return X.Retrieval(_chunks(spark, d)).answer(_questions(spark, d, 12)).select("question_id", "grounded", F.size("citations").alias("citations"))


@q("sl15_merged_runs", "SELECT o_orderkey FROM orders ORDER BY o_orderkey")
def sl15(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 2 = 1")).orderBy("o_orderkey")


@q("so3_gathered_shards", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2, 3)")
def so3(spark, d):
    c = _t(spark, d, "customer")
    return c.where("c_nationkey = 1").unionByName(c.where("c_nationkey = 2")).unionByName(c.where("c_nationkey = 3")).select("c_custkey")


@q("fn6_text_functions", "SELECT c_custkey, md5(c_name) AS h, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS p, repeat('ab', CAST(c_custkey % 3 AS INT)) AS r FROM customer")
def fn6(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.md5(F.col("c_name").cast("binary")).alias("h"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("p"), F.expr("repeat('ab', int(c_custkey % 3))").alias("r"))


@q("fn8_null_functions", "SELECT c_custkey, nullif(c_nationkey, 3) AS k, coalesce(nullif(c_nationkey, 3), -1) AS v, c_acctbal BETWEEN 0 AND 100 AS b, c_mktsegment IN ('BUILDING', 'MACHINERY') AS s FROM customer")
def fn8(spark, d):
    k = F.nullif("c_nationkey", F.lit(3))
    return _t(spark, d, "customer").select("c_custkey", k.alias("k"), F.coalesce(k, F.lit(-1)).alias("v"), F.col("c_acctbal").between(0, 100).alias("b"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("s"))


@q("fn9_unnest", "SELECT l_orderkey, i.p AS part FROM (SELECT l_orderkey, list(l_partkey) AS a FROM lineitem GROUP BY 1), unnest(a) i(p)")
def fn9(spark, d):
    return _orders(spark, d).select(F.col("_id").alias("l_orderkey"), F.explode("items.part").alias("part"))


@q("fn15_rectangles", "SELECT i AS id, CAST(i * 2 AS DOUBLE) AS area FROM range(10) t(i)")
def fn15(spark, d):
    r = spark.range(10).select("id", F.lit(1.0).alias("xmin"), F.lit(3.0).alias("xmax"), F.lit(0.0).alias("ymin"), F.col("id").cast("double").alias("ymax"))
    return r.select("id", Z.area().alias("area"))


@q("fn16_type_bracketing", "SELECT event_id FROM events WHERE false")
def fn16(spark, d):
    e = _t(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.where(D.matches_variant(F.col("v"), {"k": {"$gt": "5"}})).select("event_id")


@q("fn19_computed_fields", "SELECT o_orderkey AS _id, o_custkey AS who, o_totalprice AS total FROM orders")
def fn19(spark, d):
    a = _coll(spark, d)["orders"].aggregate([{"$project": {"pair": {"who": "$customer", "total": "$total"}}}])
    return a.select("_id", "pair.who", "pair.total")


@q("fn21_session_functions", "SELECT true AS known")
def fn21(spark, d):
    return spark.sql("SELECT current_database() IS NOT NULL AND current_user() IS NOT NULL AND version() IS NOT NULL AS known")


@q("w6_seats", "SELECT o_orderkey, accepted FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4 AS accepted FROM orders)")
def w6(spark, d):
    seats = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(4).alias("seats"))
    return C.reserve(seats, _t(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("one")), "o_custkey", "seats", "one", ["o_orderkey"]).select("o_orderkey", "accepted")


@q("w10_update_one", "SELECT o_orderkey AS _id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P') THEN 'done' ELSE o_orderstatus END AS status FROM orders")
def w10(spark, d):
    c, _ = D.Collection(_orders(spark, d).drop("items")).update_one({"status": "P"}, {"$set": {"status": "done"}})
    return c.df.select("_id", "status")


@q("w12_insert_documents", "SELECT o_orderkey AS _id, o_orderstatus AS status FROM orders UNION ALL SELECT 10000001, 'new'")
def w12(spark, d):
    c, _ = D.Collection(_orders(spark, d).drop("items")).insert_many([{"_id": 10000001, "status": "new"}])
    return c.df.select("_id", "status")


@q("w15_shard_load", "SELECT CASE WHEN o_custkey < 500 THEN 'a' WHEN o_custkey < 1000 THEN 'b' ELSE 'c' END AS shard, count(*) AS n FROM orders GROUP BY 1")
def w15(spark, d):
    return N.Router(_orders(spark, d).drop("items"), "customer", P.Ranges((500, 1000), ("a", "b", "c"))).load()


@q("u1_sql_function", "SELECT l_orderkey, CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS total FROM lineitem")
def u1(spark, d):
    scalar.register(spark)
    return _t(spark, d, "lineitem").select("l_orderkey", F.expr("cast(line_total(cast(l_quantity AS decimal(18,2)), cast(l_extendedprice AS decimal(18,2))) AS double)").alias("total"))


@q("advisor6_conjunction", "SELECT CAST(0.16 AS DOUBLE) AS share, 160 AS n, 'SeqScan' AS kind")
def op6(spark, d):
    t = A.TableStats(1000, 50, {"a": A.ColumnStats(0.1, 10, {10: 0.2, 90: 0.1}, (0, 25, 50, 75, 100)), "b": A.ColumnStats(0, 2, {"x": 0.8})})
    preds = [A.Predicate("a", "=", 10), A.Predicate("b", "=", "x")]
    p = A.recommend(t, preds)
    return spark.createDataFrame([(round(A.conjunction(t, preds), 9), p.estimated_rows, p.kind)], "share double, n int, kind string")


@q("ex1_explained_plan")
def ex1(spark, d):
    from ..plans import explain

    df = _t(spark, d, "orders").where("o_orderkey < 10").groupBy("o_orderstatus").count()
    return spark.createDataFrame(explain.operators(df), "depth int, operator string")


@q("tx6_truncation_point", "SELECT 1 AS lsn")
def tx6(spark, d):
    from ..operators import logs
    from .data import wal

    return spark.createDataFrame([(logs.truncation_point(wal(spark), 7),)], "lsn int")


@q("ix2_write_amplification", "SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT user_id) AS amplification FROM events")
def ix2(spark, d):
    e = _t(spark, d, "events")
    before = e.agg(F.count("*").alias("n"))
    after = W.newest(e.select("user_id", "event_id"), ["user_id"], ["event_id"]).agg(F.count("*").alias("m"))
    return before.join(F.broadcast(after)).select((F.col("n") / F.col("m")).alias("amplification"))


@q("ix3_clustered_window", "SELECT p_partkey AS id FROM part WHERE 25 + (p_partkey * 37 % 1000) / 100.0 BETWEEN 26 AND 27 AND 22 + (p_partkey * 91 % 1000) / 100.0 BETWEEN 23 AND 26")
def ix3(spark, d):
    return Z.window(Scratch(spark, "clustered").save(Z.cluster(_points(spark, d), 1.0, 4), "t"), 26, 23, 27, 26).select("id")


@q("ix4_unique_check", "SELECT count(*) = 0 AS is_unique FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1)")
def ix4(spark, d):
    try:
        _coll(spark, d)["customers"].create_index("name", unique=True)
        ok = True
    except D.DuplicateKeyError:
        ok = False
    return spark.createDataFrame([(ok,)], "is_unique boolean")
