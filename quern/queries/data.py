"""Versions, documents, vectors, text, partitions, graphs, space, statistics, logs and simulators on the driver's tables."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import constraints as C
from ..operators import documents as D
from ..operators import graph as G
from ..operators import logs as L
from ..operators import partitioning as P
from ..operators import simulate as S
from ..operators import spatial as Z
from ..operators import tenants as N
from ..operators import vectors as V
from ..operators import versions as W
from ..plans import advisor as A
from ..session import table as _t
from ..sources.scratch import Scratch
from . import Theme

q = Theme()

# ---- versions: events are a log of values by user


def _log(spark, d):
    return _t(spark, d, "events").select("event_id", "user_id", "value", (F.col("event_type") == "error").alias("dead"))


@q("sc15_newest_wins", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def newest(spark, d):
    return W.newest(_log(spark, d), ["user_id"], ["event_id"], F.col("dead")).drop("dead")


@q("sc16_merged_range_scan", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE user_id BETWEEN 20 AND 90) WHERE r = 1 AND event_type <> 'error'")
def merged(spark, d):
    return W.range_scan(_log(spark, d), "user_id", 20, 90, ["event_id"], F.col("dead")).drop("dead")


@q("sc25_live_keys", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error' AND NOT (CASE WHEN event_id % 3 = 0 THEN 9000 >= event_id + 50 ELSE false END)")
def live(spark, d):
    log = _log(spark, d).withColumn("expires_at", F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 50))
    return W.live(log, 9000, "user_id", "event_id", "expires_at", "dead").select("user_id", "event_id", "value")


@q("sc26_keydir", "SELECT user_id, max(event_id) AS off FROM events GROUP BY user_id")
def keydir(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("off"))


@q("sc27_compaction", "SELECT count(*) AS before, (SELECT count(*) FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error') AS after FROM events")
def compaction(spark, d):
    return W.compaction(_log(spark, d).withColumn("expires_at", F.lit(None).cast("long")), 0, key="user_id", offset="event_id", tombstone="dead")


@q("jn16_snapshot_read", "SELECT user_id, arg_max(value, event_id) AS value FROM events WHERE event_id <= 500 GROUP BY user_id")
def snapshot(spark, d):
    return W.as_of(_log(spark, d), 500, "user_id", "event_id").select("user_id", "value")


@q("jn16_as_of_join", "SELECT o_orderkey, (SELECT arg_max(value, event_id) FROM events WHERE user_id = o_custkey AND event_id <= o_orderkey) AS value FROM orders")
def as_of_join(spark, d):
    reads = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("snapshot"))
    return W.as_of_each(reads, _log(spark, d), "user_id", "event_id", "value").select("o_orderkey", "value")


@q("tx2_write_conflicts", "SELECT user_id, snapshot FROM (SELECT user_id, min(event_id) + 100 AS snapshot, max(event_id) AS last FROM events GROUP BY user_id) WHERE last > snapshot")
def conflicts(spark, d):
    writes = _t(spark, d, "events").groupBy("user_id").agg((F.min("event_id") + 100).alias("snapshot"))
    return W.write_conflicts(writes, _log(spark, d), "user_id", "event_id")


@q("ag23_last_writer", "SELECT user_id, event_id, value, event_type AS node FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id // 10 DESC, event_type DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_writer(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", "value", F.col("event_type").alias("node"), F.floor(F.col("event_id") / 10).alias("ts"))
    return W.newest(e, ["user_id"], ["ts", "node", "event_id"]).drop("ts")


@q("ag23_lost_writes", """
WITH w AS (SELECT user_id, event_id AS ts, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS node, value FROM events),
own AS (SELECT user_id, node, max(ts) AS ts, arg_max(value, ts) AS value FROM w GROUP BY user_id, node)
SELECT user_id, node AS side, ts, value FROM own o WHERE ts < (SELECT max(ts) FROM own p WHERE p.user_id = o.user_id)""")
def lost(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("ts"), "value", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("node"))
    return W.lost_writes(e.withColumn("side", F.col("node")), "side", "user_id").select("user_id", "side", "ts", "value")


@q("w13_merged_columns", "SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS seen FROM events GROUP BY user_id")
def merged_columns(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("click"), F.when(F.col("event_type") == "view", F.col("value")).alias("seen"))
    return W.merge_columns(e, ["user_id"], ["event_id"])


@q("w14_counter", "SELECT event_id, CAST(sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events")
def counter(spark, d):
    return W.increments(_log(spark, d).withColumn("by", F.col("event_id") % 5), "user_id", "by", ["event_id"]).select("event_id", "total")


@q("sc28_partition_range", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn BETWEEN 1 AND 4")
def partition_range(spark, d):
    return W.select_partition(_t(spark, d, "conversations"), {"conv_id": 3}, ["turn"], (1,), (4,), True).select("conv_id", "turn", "role")


@q("sc29_filtered_scan", "SELECT conv_id, turn FROM conversations WHERE role = 'system'")
def filtered_scan(spark, d):
    return W.select_where(_t(spark, d, "conversations"), F.col("role") == "system", allow_filtering=True).select("conv_id", "turn")


# ---- documents: orders with their lines


def _orders(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("items"))
    o = _t(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), "items", F.array("o_orderkey").alias("_seq"))


def _coll(spark, d):
    db = {}
    db["orders"] = D.Collection(_orders(spark, d), db)
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.array("c_custkey").alias("_seq"))
    db["customers"] = D.Collection(c, db)
    return db


@q("pf7_document_filter", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus IN ('F', 'O') AND (o_totalprice > 200000 OR o_custkey = 5) AND NOT (o_custkey > 1000)")
def document_filter(spark, d):
    return _coll(spark, d)["orders"].find({"status": {"$in": ["F", "O"]}, "$or": [{"total": {"$gt": 200000}}, {"customer": 5}], "$nor": [{"customer": {"$gt": 1000}}]}).select("_id")


@q("pf8_array_contains", "SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_partkey = 77")
def array_contains(spark, d):
    return _coll(spark, d)["orders"].find({"items.part": 77}).select("_id")


@q("pf10_not_in", "SELECT o_orderkey AS _id FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def not_in(spark, d):
    return _coll(spark, d)["orders"].find({"status": {"$nin": ["F", "P"]}}).select("_id")


@q("pf11_exists", "SELECT o_orderkey AS _id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def exists(spark, d):
    return _coll(spark, d)["orders"].find({"items": {"$exists": False}}).select("_id")


@q("pf12_regex", "SELECT c_custkey AS _id FROM customer WHERE regexp_matches(c_name, '00007$')")
def regex(spark, d):
    return _coll(spark, d)["customers"].find({"name": {"$regex": "00007$"}}).select("_id")


@q("pf13_size", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING count(*) = 5")
def size(spark, d):
    return _coll(spark, d)["orders"].find({"items": {"$size": 5}}).select("_id")


@q("pf14_all", "SELECT l_orderkey AS _id FROM lineitem GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')")
def all_of(spark, d):
    db = _coll(spark, d)
    flags = D.Collection(db["orders"].df.withColumn("flags", F.transform("items", lambda x: x["flag"])))
    return flags.find({"flags": {"$all": ["A", "R"]}}).select("_id")


@q("pf15_elem_match", "SELECT DISTINCT l_orderkey AS _id FROM lineitem WHERE l_returnflag = 'R' AND CAST(l_quantity AS INT) >= 48")
def elem_match(spark, d):
    return _coll(spark, d)["orders"].find({"items": {"$elemMatch": {"flag": "R", "qty": {"$gte": 48}}}}).select("_id")


@q("sl3_document_page", "SELECT o_orderkey AS _id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def document_page(spark, d):
    return _coll(spark, d)["orders"].find({"status": "P"}, {"total": 1}, [("total", -1)], 5, 10)


@q("ag8_group", "SELECT o_orderstatus AS _id, count(*) AS n, round(avg(o_custkey), 6) AS mean, max(o_totalprice) AS top, min(o_orderkey) AS first FROM orders GROUP BY 1")
def group(spark, d):
    g = _coll(spark, d)["orders"].aggregate([{"$group": {"_id": "$status", "n": {"$sum": 1}, "mean": {"$avg": "$customer"}, "top": {"$max": "$total"}, "first": {"$first": "$_id"}}}])
    return g.select("_id", F.col("n").cast("long").alias("n"), F.round("mean", 6).alias("mean"), "top", "first")


@q("fn18_unwind_group", "SELECT l_partkey AS _id, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY units DESC, _id LIMIT 20")
def unwind(spark, d):
    return _coll(spark, d)["orders"].aggregate([{"$match": {"status": "F"}}, {"$unwind": "$items"}, {"$group": {"_id": "$items.part", "units": {"$sum": "$items.qty"}}}, {"$sort": {"units": -1, "_id": 1}}, {"$limit": 20}])


@q("jn9_lookup", "SELECT o_orderkey AS _id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000")
def lookup(spark, d):
    a = _coll(spark, d)["orders"].aggregate([{"$match": {"total": {"$gt": 300000}}}, {"$lookup": {"from": "customers", "localField": "customer", "foreignField": "_id", "as": "c"}}, {"$unwind": "$c"}, {"$project": {"name": "$c.name"}}])
    return a.select("_id", "name")


@q("ag13_count", "SELECT count(*) AS n FROM orders WHERE o_custkey = 10")
def count(spark, d):
    return _coll(spark, d)["orders"].aggregate([{"$match": {"customer": 10}}, {"$count": "n"}])


@q("ag15_distinct", "SELECT DISTINCT l_returnflag AS value FROM lineitem")
def distinct(spark, d):
    return _coll(spark, d)["orders"].distinct("items.flag")


@q("w9_update", "SELECT o_orderkey AS _id, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1000 ELSE o_custkey END AS customer FROM orders")
def update(spark, d):
    df = _orders(spark, d).drop("items")
    return D.apply_update(df, D.condition(df, {"status": "P"}), {"$set": {"status": "X"}, "$inc": {"customer": 1000}}).select("_id", "status", "customer")


@q("w11_delete", "SELECT o_orderkey AS _id FROM orders WHERE NOT (o_totalprice < 250000)")
def delete(spark, d):
    return D.Collection(_orders(spark, d).drop("items")).delete_many({"total": {"$lt": 250000}})[0].find({}).select("_id")


@q("pf21_tenant_scope", "SELECT o_orderkey AS _id FROM orders WHERE o_custkey = 12 AND o_orderstatus = 'O'")
def tenant(spark, d):
    return N.Session({"orders": D.Collection(_orders(spark, d).drop("items"))}, 12, "customer").find("orders", {"status": "O"}).select("_id")


@q("pt2_routed_find", "SELECT o_orderkey AS _id, o_totalprice AS total FROM orders WHERE o_custkey IN (3, 700) ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def routed(spark, d):
    r = N.Router(_orders(spark, d).drop("items"), "customer", P.Ranges((500, 1000), ("a", "b", "c")))
    return r.find({"customer": {"$in": [3, 700]}}, [("total", -1)], 0, 12, {"total": 1})


@q("tx14_batch_transfers")
def batch_transfers(spark, d):
    a = _t(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("tx"), F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + 1) % 1000).alias("dst"), F.lit(50).cast("decimal(12,2)").alias("amount"))
    return N.transfers(a, o)[0]


@q("pf11_variant_exists", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def variant(spark, d):
    e = _t(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return e.where(D.matches_variant(F.col("v"), {"k": {"$exists": True, "$gte": 50}})).select("event_id")


# ---- vectors

_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"


def _query(spark, d, *ids):
    """The given vectors."""
    return {r["vec_id"]: [float(x) for x in r["embedding"]] for r in _t(spark, d, "embeddings").where(F.col("vec_id").isin(*ids)).collect()}


def _query_set(spark, d):
    """A stated query set, as a table: the vectors whose id is divisible by 20."""
    return _t(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@q("sl6_knn_cosine", f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def knn_cosine(spark, d):
    return V.knn(_t(spark, d, "embeddings"), _query(spark, d, 7)[7], 10)


@q("sl6_knn_l2", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score, vec_id LIMIT 10")
def knn_l2(spark, d):
    return V.knn(_t(spark, d, "embeddings"), _query(spark, d, 7)[7], 10, "l2")


@q("sl6_knn_dot", f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST({_Q} AS DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def knn_dot(spark, d):
    return V.knn(_t(spark, d, "embeddings"), _query(spark, d, 7)[7], 10, "dot")


@q("wn4_knn_batch", """
SELECT qid, rank, vec_id FROM (
  SELECT a.vec_id AS qid, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_batch(spark, d):
    return V.knn_batch(_t(spark, d, "embeddings"), _query_set(spark, d), 5).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id")


#: (lists, passes, probes) of sl11; on vectors without clear clusters fewer probes lose over a tenth of the true neighbours.
LISTS = (16, 5, 12)


@q("sl11_inverted_lists")
def ivf(spark, d):
    return V.InvertedLists(*LISTS[:2]).build(_t(spark, d, "embeddings")).search(_query_set(spark, d), 10, LISTS[2])


@q("sl12_graph_index")
def hnsw(spark, d):
    return V.graph_search(_t(spark, d, "embeddings"), _query_set(spark, d), 10)


@q("ag20_index_recall")
def index_recall(spark, d):
    """The mean recall of what sl11 and sl12 register; ag20_recall probes all lists, which must lose nothing."""
    truth = V.knn_batch(_t(spark, d, "embeddings"), _query_set(spark, d), 10)
    mean = lambda name, found: V.recall(found, truth).agg(F.lit(name).alias("query"), F.avg("recall").alias("recall"))
    return mean("sl11_inverted_lists", ivf(spark, d)).unionByName(mean("sl12_graph_index", hnsw(spark, d)))


@q("ag20_recall", "SELECT vec_id AS qid, CAST(1 AS DOUBLE) AS recall FROM embeddings WHERE vec_id % 20 = 0")
def recall(spark, d):
    e, qs = _t(spark, d, "embeddings"), _query_set(spark, d)
    return V.recall(V.InvertedLists(16, 3).build(e).search(qs, 10, 16), V.knn_batch(e, qs, 10))


@q("jn18_versioned_search", "SELECT b.vec_id FROM embeddings a, embeddings b WHERE a.vec_id = 5 ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id LIMIT 8")
def versioned(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    old = e.where("vec_id % 3 = 0").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"), F.lit(1).alias("version"))
    return V.versioned_search(e.withColumn("version", F.lit(2)).unionByName(old).unionByName(e.withColumn("version", F.lit(2))), _query(spark, d, 5), 8).select("vec_id")


@q("fn3_normalized", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * 0 + 1, 6) AS length FROM embeddings")
def normalized(spark, d):
    from ..functions import scalar

    e = _t(spark, d, "embeddings").select("vec_id", scalar.normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(F.sqrt(scalar.dot(F.col("v"), F.col("v"))), 6).alias("length"))


# ---- text


@q("fn11_tokens", r"SELECT item_id, CAST(len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1 AND x NOT IN (" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "))) AS BIGINT) AS n FROM benchmark")
def tokens(spark, d):
    t = X.tokens(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", F.size(F.filter(t, lambda x: ~x.contains("_"))).cast("long").alias("n"))


@q("fn13_sentences", r"SELECT item_id, CAST(len(regexp_split_to_array(trim(text), '[.!?]\s+')) AS BIGINT) AS n FROM benchmark")
def sentences(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.size(F.split(F.trim("text"), r"(?<=[.!?])\s+")).cast("long").alias("n"))


def _chunks(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("source"), F.lit("").alias("heading"), "text")


def _questions(spark, d, words):
    """A stated set of questions: the first words of each item whose id is divisible by 20."""
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    return _t(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("question_id"), F.array_join(F.slice(w, 1, words), " ").alias("question"))


@q("ag19_document_frequency")
def frequency(spark, d):
    return _chunks(spark, d).select("id", F.explode(F.array_distinct(X.slots(X.tokens(F.col("text"))))).alias("slot")).groupBy("slot").agg(F.count("*").alias("df"))


@q("sl13_retrieve")
def retrieve(spark, d):
    return X.Retrieval(_chunks(spark, d)).retrieve(_questions(spark, d, 12)).select("question_id", "rank", "id", F.round("score", 6).alias("score"))


@q("sc30_markdown_chunks")
def markdown(spark, d):
    return X.chunks(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"))


# ---- partitions


_MD5 = "CAST(('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 15)) AS BIGINT)"


@q("pt1_ranges", "SELECT o_orderkey, CASE WHEN o_custkey < 300 THEN 'a' WHEN o_custkey < 900 THEN 'b' ELSE 'c' END AS shard FROM orders")
def ranges(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", P.Ranges((300, 900), ("a", "b", "c")).shard(F.col("o_custkey")).alias("shard"))


@q("pt1_hashed", f"SELECT o_orderkey, ['a', 'b', 'c', 'd'][1 + {_MD5.format('o_orderkey')} % 4] AS shard FROM orders")
def hashed(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", P.Hashed(("a", "b", "c", "d")).shard(F.col("o_orderkey")).alias("shard"))


@q("jn14_ring", f"""
WITH points AS (SELECT {_MD5.format("n || '#' || i")} AS p, n FROM (VALUES ('n1'), ('n2'), ('n3')) t(n), range(50) r(i)),
keys AS (SELECT o_orderkey, {_MD5.format('o_orderkey')} AS h FROM orders)
SELECT o_orderkey, coalesce((SELECT arg_min(n, p) FROM points WHERE p >= h), (SELECT arg_min(n, p) FROM points)) AS node FROM keys""")
def ring(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey")
    return P.Ring(["n1", "n2", "n3"], 50).place(o, "o_orderkey").select("o_orderkey", F.col("replicas")[0].alias("node"))


@q("pt1_preference_list")
def preference(spark, d):
    return P.Ring(["n1", "n2", "n3", "n4"], 20).place(_t(spark, d, "customer").select("c_custkey"), "c_custkey", 3)


@q("fn4_exact_hash")
def exact_hash(spark, d):
    return _t(spark, d, "customer").select("c_custkey", P.Hashed(("a", "b", "c"), exact=True).shard(F.col("c_custkey")).alias("shard"))


@q("ag16_skew", "SELECT max(n) / (sum(n) / 3.0) AS skew FROM (SELECT CASE WHEN o_custkey < 300 THEN 'a' WHEN o_custkey < 900 THEN 'b' ELSE 'c' END AS s, count(*) AS n FROM orders GROUP BY 1)")
def skew(spark, d):
    return P.skew(P.load(ranges(spark, d), "shard"), 3)


@q("ag16_moved", "SELECT avg(CASE WHEN o_custkey >= 100 AND o_custkey < 300 THEN 1.0 ELSE 0.0 END) AS moved FROM orders")
def moved(spark, d):
    a = P.Ranges((300, 900), ("a", "b", "c"))
    o = _t(spark, d, "orders").select(a.shard(F.col("o_custkey")).alias("x"), a.cut("a", 100, "d").shard(F.col("o_custkey")).alias("y"))
    return P.moved(o, "x", "y")


# ---- graphs: nations trade with the nations whose suppliers have the next keys


def _edges(spark, d):
    n = _t(spark, d, "nation")
    e = n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("dst"))
    return e.unionByName(n.select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") + 5) % 25).cast("long").alias("dst"))).where("src <> dst").withColumn("type", F.lit("TRADES"))


_E = "e AS (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS src, CAST(d AS BIGINT) AS dst FROM nation, unnest([(n_nationkey * 3 + 1) % 25, (n_nationkey + 5) % 25]) t(d) WHERE n_nationkey <> d)"


@q("jn11_neighbours", f"WITH {_E} SELECT dst AS id FROM e WHERE src = 4")
def neighbours(spark, d):
    return G.neighbours(_edges(spark, d), 4, "TRADES")


@q("jn13_suggestions", f"WITH {_E} SELECT DISTINCT a.src AS id, b.dst AS suggested FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst AND NOT EXISTS (SELECT 1 FROM e c WHERE c.src = a.src AND c.dst = b.dst)")
def suggestions(spark, d):
    return G.suggestions(_edges(spark, d))


@q("jn12_pattern", f"WITH {_E} SELECT src AS a, dst AS b FROM e JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst WHERE x.n_regionkey = 1 AND y.n_regionkey = 2")
def pattern(spark, d):
    nodes = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("label"))
    return G.match(nodes, _edges(spark, d), "R1", "TRADES", "R2")


@q("gr1_shortest_path", f"WITH RECURSIVE {_E}, r(id, hop) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, hop + 1 FROM r JOIN e ON e.src = r.id WHERE hop < 10) SELECT CAST(min(hop) AS BIGINT) AS hops FROM r WHERE id = 23")
def path(spark, d):
    p = G.shortest_path(_edges(spark, d), 0, 23)
    return spark.createDataFrame([(len(p) - 1 if p else None,)], "hops long")


@q("tx4_wait_cycles", "SELECT x AS id FROM (VALUES (CAST(1 AS BIGINT)), (2), (3), (7)) t(x)")
def cycles(spark, d):
    return G.cycle_nodes(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, 7), (8, 9)], "src long, dst long"))


# ---- space: parts as points


def _points(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), (25 + F.col("p_partkey") * 37 % 1000 / 100).alias("x"), (22 + F.col("p_partkey") * 91 % 1000 / 100).alias("y"))
    return Z.rect(p)


_P = "p AS (SELECT p_partkey AS id, 25 + (p_partkey * 37 % 1000) / 100.0 AS x, 22 + (p_partkey * 91 % 1000) / 100.0 AS y FROM part)"


@q("sl10_window", f"WITH {_P} SELECT id FROM p WHERE x BETWEEN 27 AND 29 AND y BETWEEN 24 AND 25.5")
def window(spark, d):
    return Z.window(_points(spark, d), 27, 24, 29, 25.5).select("id")


@q("sl9_nearest", f"WITH {_P} SELECT id FROM p ORDER BY round((x - 30.1) * (x - 30.1) + (y - 27.3) * (y - 27.3), 9), id LIMIT 7")
def nearest(spark, d):
    return _points(spark, d).select("id", F.round(Z.min_dist2(30.1, 27.3), 9).alias("d")).orderBy("d", "id").limit(7).select("id")


@q("pf24_window_join", f"WITH {_P}, w AS (SELECT i AS wid, 25 + i AS a, 22 + i / 2.0 AS b FROM range(8) t(i)) SELECT wid, id FROM p, w WHERE x BETWEEN a AND a + 1.5 AND y BETWEEN b AND b + 2")
def window_join(spark, d):
    w = spark.range(8).select(F.col("id").alias("wid"), (25 + F.col("id")).cast("double").alias("xmin"), (22 + F.col("id") / 2).alias("ymin")).withColumns({"xmax": F.col("xmin") + 1.5, "ymax": F.col("ymin") + 2})
    return Z.join_windows(_points(spark, d), w, 1.0)


# ---- statistics and plans


@q("ag18_column_statistics", "SELECT 'o_orderstatus' AS column, count(*) AS rows, CAST(0 AS DOUBLE) AS null_frac, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_custkey', count(*), CAST(0 AS DOUBLE), count(DISTINCT o_custkey) FROM orders")
def statistics(spark, d):
    return A.collect_stats(_t(spark, d, "orders"), ["o_orderstatus", "o_custkey"]).select("column", "rows", F.col("null_frac").cast("double").alias("null_frac"), "n_distinct")


@q("advisor5_plan_choice", "SELECT value, kind, n, CAST(cost AS DOUBLE) AS cost FROM (VALUES ('rare', 'IndexScan', 150, 229.8), ('hot', 'SeqScan', 6000, 300.0)) t(value, kind, n, cost)")
def plans(spark, d):
    t = A.TableStats(10_000, 200, {"status": A.ColumnStats(0.05, 12, {"hot": 0.60, "warm": 0.20})}, frozenset({"status"}))
    rows = []
    for v in ("rare", "hot"):
        p = A.recommend(t, [A.Predicate("status", "=", v)])
        rows.append((v, p.kind, p.estimated_rows, round(p.estimated_cost, 6)))
    return spark.createDataFrame(rows, "value string, kind string, n int, cost double")


# ---- logs

WAL = [
    (1, "BEGIN", 1, None, None, None, None, None), (2, "BEGIN", 2, None, None, None, None, None), (3, "BEGIN", 3, None, None, None, None, None),
    (4, "UPDATE", 1, 1, "A", 100, 150, None), (5, "UPDATE", 2, 2, "B", 200, 250, None), (6, "UPDATE", 3, 3, "C", 300, 350, None),
    (7, "CKPT_BEGIN", None, None, None, None, None, None), (8, "CKPT_END", None, None, None, None, None, None),
    (9, "UPDATE", 2, 5, "D", 400, 450, None), (10, "COMMIT", 2, 9, None, None, None, None), (11, "END", 2, 10, None, None, None, None),
    (12, "UPDATE", 1, 4, "B", 250, 260, None), (13, "UPDATE", 3, 6, "D", 450, 470, None),
]


def wal(spark, rows=None):
    kind = "lsn int, kind string, tx_id int, prev_lsn int, page_id string, before int, after int, undo_next_lsn int"
    d = spark.createDataFrame(rows or WAL, kind)
    att = F.expr("array(named_struct('tx', 1, 'status', 'running', 'last_lsn', 4), named_struct('tx', 2, 'status', 'running', 'last_lsn', 5), named_struct('tx', 3, 'status', 'running', 'last_lsn', 6))")
    dpt = F.expr("array(named_struct('page', 'A', 'rec_lsn', 4), named_struct('page', 'B', 'rec_lsn', 5), named_struct('page', 'C', 'rec_lsn', 6))")
    return d.withColumns({"att": F.when(F.col("kind") == "CKPT_END", att), "dpt": F.when(F.col("kind") == "CKPT_END", dpt)})


@q("tx7_analysis", "SELECT * FROM (VALUES (1, 'running', 12), (3, 'running', 13)) t(tx_id, status, last_lsn)")
def analysis(spark, d):
    return L.analysis(wal(spark), 7)


@q("tx7_dirty_pages", "SELECT * FROM (VALUES ('A', 4), ('B', 5), ('C', 6), ('D', 9)) t(page_id, rec_lsn)")
def dirty(spark, d):
    return L.dirty_pages(wal(spark), 7)


@q("tx8_redo", "SELECT * FROM (VALUES (4, 'A', 'apply'), (5, 'B', 'apply'), (6, 'C', 'pageLSN >= LSN'), (9, 'D', 'apply'), (12, 'B', 'apply'), (13, 'D', 'apply')) t(lsn, page_id, decision)")
def redo(spark, d):
    disk = spark.createDataFrame([("A", 100, 0), ("B", 200, 0), ("C", 350, 6), ("D", 400, 0)], "page_id string, value int, page_lsn int")
    return L.redo(wal(spark), disk, 7)


@q("tx9_undo", "SELECT * FROM (VALUES (13, 3, 'D', 450), (12, 1, 'B', 250), (6, 3, 'C', 300), (4, 1, 'A', 100)) t(lsn, tx_id, page_id, before)")
def undo(spark, d):
    return L.undo_records(wal(spark), L.analysis(wal(spark), 7).where("status <> 'committed'"))


@q("tx10_failover_loss", "SELECT '3,4' AS lost, CAST(8 AS DOUBLE) AS w")
def failover(spark, d):
    c = spark.createDataFrame([(1, 10, 0.0), (2, 25, 4.0), (3, 40, 9.5), (4, 52, 12.0)], "tx_id int, commit_lsn int, commit_time double")
    return L.failover_loss(c, 30).select(F.array_join(F.col("lost").cast("array<string>"), ",").alias("lost"), F.col("window").alias("w"))


@q("tx14_two_phase", "SELECT * FROM (VALUES ('t1', 'COMMIT'), ('t2', 'ABORT')) t(tx, decision)")
def two_phase(spark, d):
    votes = S.transfer_log(spark, {"t1": {"s1:alice": -30, "s2:carol": 30}, "t2": {"s1:alice": -500, "s2:carol": 500}}, {"s1": {"alice": 100}, "s2": {"carol": 50}})
    none = spark.createDataFrame([], "tx string, kind string")
    return L.two_phase(votes, none, spark.createDataFrame([], "participant string, tx string, kind string"))["outcome"]


@q("jn17_in_doubt", "SELECT * FROM (VALUES ('s2', 't2', 'ABORT'), ('s2', 't3', 'COMMIT')) t(participant, tx, decision)")
def in_doubt(spark, d):
    log = spark.createDataFrame([("s1", "t1", "PREPARED"), ("s1", "t1", "COMMIT"), ("s2", "t2", "PREPARED"), ("s2", "t3", "PREPARED")], "participant string, tx string, kind string")
    votes = spark.createDataFrame([("s1", "t1", "YES")], "participant string, tx string, vote string")
    return L.two_phase(votes, spark.createDataFrame([("t3", "COMMIT")], "tx string, kind string"), log)["resolved"]


@q("tx12_audit_chain", "SELECT CAST(o_custkey AS VARCHAR) AS log, min(seq) FILTER (WHERE o_orderkey % 97 = 0) AS first_damaged FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders) GROUP BY o_custkey")
def audit(spark, d):
    from pyspark.sql import Window

    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("seq"))
    sealed = L.seal(o, "o_custkey", "seq", F.to_json(F.struct("seq", F.col("o_orderkey").alias("event"), F.col("o_orderstatus").alias("user"))))
    hurt = F.get_json_object("body", "$.event").cast("long") % 97 == 0
    return L.first_damaged(sealed.withColumn("body", F.when(hurt, F.regexp_replace("body", '"user": "', '"user": "x')).otherwise(F.col("body"))))


@q("wn2_turn_chain", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations")
def chain(spark, d):
    from pyspark.sql import Window

    return _t(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


# ---- simulators and sinks


@q("wn7_lru_trace", "SELECT * FROM (VALUES (0, 0, false), (1, 1, false), (2, 2, false), (3, 0, true), (4, 3, false), (5, 1, false)) t(pos, page, hit)")
def lru_trace(spark, d):
    return S.lru_hits(spark.createDataFrame(list(enumerate([0, 1, 2, 0, 3, 1])), "pos int, page int"), 3)


@q("ca2_cache_study")
def cache_study(spark, d):
    return S.cache_study(S.workloads(spark, 200, 3000))


@q("tx20_split_votes")
def split_votes(spark, d):
    return S.split_votes(spark)


@q("ag24_availability", "SELECT * FROM (VALUES ('ap', 'left', 2, 2, 0), ('ap', 'right', 1, 1, 1)) t(system, side, ok, total, stale)")
def availability(spark, d):
    rows = [("ap", "left", 1, "write", "x", 1, True), ("ap", "left", 2, "write", "x", 2, True), ("ap", "right", 3, "read", "x", 1, True)]
    a = S.availability(spark.createDataFrame(rows, "system string, side string, seq int, op string, key string, value int, ok boolean"))
    return a.select("system", "side", F.col("ok").cast("int").alias("ok"), F.col("total").cast("int").alias("total"), F.col("stale").cast("int").alias("stale"))


@q("sc32_encrypted_pages", "SELECT c_custkey, c_name AS page, CAST(NULL AS VARCHAR) AS moved FROM customer")
def encrypted(spark, d):
    from ..sources import files

    key = "00112233445566778899aabbccddeeff00112233445566778899aabbccddeeff"
    c = _t(spark, d, "customer").select("c_custkey", files.encrypted(F.col("c_name").cast("binary"), F.col("c_custkey"), key).alias("e"))
    return c.select("c_custkey", files.decrypted(F.col("e"), F.col("c_custkey"), key).cast("string").alias("page"), files.decrypted(F.col("e"), F.col("c_custkey") + 1, key).cast("string").alias("moved"))


@q("w8_unique", "SELECT l_orderkey, 'unique:l_orderkey,l_linenumber' AS rule FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) USING (l_orderkey, l_linenumber)")
def unique(spark, d):
    return C.violations(_t(spark, d, "lineitem"), ["l_orderkey"], unique=(("l_orderkey", "l_linenumber"),))


# ---- streams: files are read as they come, to the end


def _ended(stream, name, mode):
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _filed(stream, name):
    """The rows of a stream that only adds rows, run to its end, as files in the shared folder: the driver gets none of them.

    Unless the caller chose a store, state is kept by RocksDB on the executors' disks; Spark's default holds every key in memory.
    """
    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    rows, state, chosen = Scratch(spark, name), Scratch(spark, f"{name}-state"), spark.conf.get(key, None)
    if not chosen:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = stream.writeStream.format("parquet").option("checkpointLocation", state.root).trigger(availableNow=True).start(rows.root)
    finally:
        if not chosen:
            spark.conf.unset(key)
    run.awaitTermination()
    state.drop()
    return spark.read.schema(stream.schema).parquet(rows.root)


def _event_stream(spark, d):
    # a pattern: a stream can't be told to read one file, and the table may be a file or a folder
    return spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@q("st1_hourly_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly(spark, d):
    from ..streaming import views

    s = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = _ended(views.windowed(s, "ts", ["event_type"], "1 day", "40 days"), "st1", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@q("st2_once_per_key", "SELECT count(DISTINCT event_id) AS n FROM events")
def once(spark, d):
    from ..streaming import views

    # the first watermark is 1970: what is not after it would be late
    ts = F.greatest(F.col("ts").cast("timestamp"), F.timestamp_millis(F.lit(1)))
    s = _event_stream(spark, d).where("event_id IS NOT NULL").select("event_id", ts.alias("ts"))
    return _filed(views.once(s, "ts", ["event_id"], "40 days").select("event_id"), "st2").agg(F.count("*").alias("n"))
