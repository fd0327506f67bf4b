"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies that each of its documents should get: a whole part and a
probability. Pairs of documents then trade words: one gains as many as the other gives, at random so that no probability
changes in expectation, until one of the two is decided. Each bucket of a source leaves at most one undecided document;
those meet in a tree of tasks, and the last one of a source is rounded. Large documents trade first, so the last one is small
where there are many, and a source's words miss its target by at most half of that one document.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, text_of

EPS = 1e-12
BROADCAST_ROWS = 200_000  #: of a row for each source, or of an id, a source and a hash
CAP, WEIGHTS = 3.0, (1, 2, 3)


def targets(sizes: DataFrame, tmp: Scratch, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n, k, target) of (source, source_size, n): shares of all words by weight, at most cap times a size.

    Sources are numbered (k) by code point, null last. The words of a unit of weight start as all words by all weights and grow as
    sources reach their cap; each step is two sums, so any number of sources will do and none comes to the driver. An exact sum
    of whole numbers makes reruns agree.
    """
    order = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    order = tmp.save(order, "order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    first, offsets = 0, []
    for r in order.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row a partition of the sort
        offsets.append((r["p"], first))
        first += r["n"]
    starts = sizes.sparkSession.createDataFrame(offsets, "p long, first long")
    order = order.join(F.broadcast(starts), part == F.col("p")).withColumn("k", F.col("first") + place).drop("p", "first", "at")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("k", F.lit(len(weights))).cast("int"))
    order = tmp.save(order.withColumn("w", weight.cast("long")), "numbered")
    words = order.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while True:
        r = order.agg(F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("held"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("free")).first()
        new = max(level, (words - cap * r["held"]) / r["free"]) if r["free"] else level
        if new == level:
            break
        level, capped = new, F.col("w") * F.lit(new) > F.lit(cap) * F.col("source_size")
    return order.select("source", "source_size", "n", "k", F.when(capped, F.lit(cap) * F.col("source_size")).otherwise(F.lit(level) * F.col("w")).alias("target"))


def trade(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decides all but at most one of the probabilities p; sum(p * size) and each expectation stay."""
    p, size = p.astype(float).copy(), size.astype(float)
    draws, at = rng.random(len(p)), -1
    for j in range(len(p)):
        if size[j] <= 0:
            p[j] = 0.0
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            continue
        if at < 0:
            at = j
            continue
        i = at
        up, down = min(size[i] * (1 - p[i]), size[j] * p[j]), min(size[i] * p[i], size[j] * (1 - p[j]))
        d = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + d / size[i], p[j] - d / size[j]
        for k in (i, j):
            if not EPS < p[k] < 1 - EPS:
                p[k] = float(round(p[k]))
        at = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _step(seed: int, last: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        size = t["size"].to_numpy()
        order = np.lexsort((t["doc_id"].fill_null(0).to_numpy(), t["u"].to_numpy(), -size))  # so that small documents are left for last
        t = t.take(pa.array(order))
        p = trade(t["p"].to_numpy(), size[order], np.random.default_rng([seed, key[0].as_py(), key[1].as_py()]))
        if last:  # one document of the source may be undecided: it goes to the nearer end
            p = np.where((p > 0) & (p < 1), p >= 0.5, p).astype(float)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))

    return run


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A row's own random number, which also tells texts of one id apart."""
    return F.xxhash64(F.lit(seed), doc_id.cast("long"), text)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, bucket_rows: int = 2000, fan_in: int = 64, keys: bool = False) -> DataFrame:
    """One row for each input row: (doc_id, size, source_size, target, taken[, source, u, copies]); taken is size times copies.

    Null text has size 0; the null source is a source, the last one; null ids are kept as they are. Documents are put into buckets
    by a hash of id and text, so the result doesn't depend on how the input is partitioned, and a hot source is many buckets.
    Rows that repeat are separate documents, of which equal ones are interchangeable. An empty table gives an empty result.
    Further columns of any name are not read. A bucket holds about `bucket_rows` rows without their texts.
    """
    tmp = Scratch(df.sparkSession, "mixing")
    text = text_of(text_col)
    rows = tmp.save(df.select(df[id_col].cast("long").alias("doc_id"), df[source_col].cast("string").alias("source"), word_count(text).alias("size"), _draw(seed, df[id_col], text).alias("u")), "sizes")
    aim = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), tmp, cap, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.least(F.floor(ratio + EPS), F.lit(int(cap))).cast("int")
    info = tmp.save(aim.select("k", F.col("source").alias("name"), "source_size", "target", whole.alias("whole"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), ratio - whole)).alias("p"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("buckets")), "info")
    most = info.agg(F.max("buckets")).first()[0] or 1
    table = F.broadcast(info) if info.count() <= BROADCAST_ROWS else info
    cols = ["k", "doc_id", "size", "u", "p", "bucket"]
    level = rows.join(table, F.col("source").eqNullSafe(F.col("name"))).withColumn("bucket", F.pmod("u", "buckets").cast("int")).select(*cols)
    parts, n = [], 0
    while True:
        last = most == 1
        done = tmp.save(level.groupBy("k", "bucket").applyInArrow(_step(seed + n, last), "k long, doc_id long, size long, u long, p double, bucket int"), f"level{n}")
        parts.append(done.where("p = 0 or p = 1"))
        if last:
            break
        level, most, n = done.where("p > 0 and p < 1").withColumn("bucket", (F.col("bucket") / fan_in).cast("int")), math.ceil(most / fan_in), n + 1
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(0)).cast("long")
    out = out.select("k", "doc_id", "size", "u", F.col("p").alias("_p")).join(table, "k").withColumn("p", F.col("_p"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *[F.col("name").alias("source"), F.col("u"), copies.alias("copies")] * keys)


def repeat_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """The mix itself: each row of df as often as mix() takes it, all columns kept, whatever their names.

    Rows meet their decision by id, source and a hash of id and text. Rows that agree in all three have equal texts; they are numbered
    in order of all their columns, and their decisions in order of copies. As many rows come out as mix() has copies in all:
    null ids and null sources take part, null and empty texts have no words and are never taken, and an empty table gives an
    empty one.
    """
    tmp = Scratch(df.sparkSession, "mix-rows")
    m = tmp.save(mix(df, id_col, text_col, source_col, seed=seed, keys=True, **how).select("doc_id", "source", "u", "copies"), "copies")
    i, s, u, c, r = (fresh(df, x) for x in ("mix_id", "mix_source", "mix_draw", "mix_copies", "mix_rank"))
    key = [i, s, u]
    keyed = m.groupBy("doc_id", "source", "u").agg(F.count("*").alias("rows"), F.sum("copies").alias(c)).toDF(i, s, u, "rows", c)
    single = tmp.save(keyed.where((F.col("rows") == 1) & (F.col(c) > 0)).drop("rows"), "single")
    many = tmp.save(keyed.where("rows > 1").select(*key), "many")
    rows = df.withColumns({i: df[id_col].cast("long"), s: df[source_col].cast("string"), u: _draw(seed, df[id_col], text_of(text_col))})

    def on(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
        cond = F.lit(True)
        for x in names:
            cond = cond & a[x].eqNullSafe(b[x])
        return cond

    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    plain, x = [F.col(f"`{x}`") for x in df.columns], fresh(df, "mix_copy")
    again = lambda d: d.withColumn(x, F.explode(F.sequence(F.lit(1).cast("long"), F.col(c)))).select(*plain)
    one = rows.alias("a").join(small(single).alias("b"), on(rows, single, key)).select("a.*", F.col(f"b.{c}").alias(c))
    out = again(one)
    if many.isEmpty():
        return out
    several = rows.join(small(many), on(rows, many, key), "left_semi").withColumn(r, F.row_number().over(Window.partitionBy(*key).orderBy(*[F.to_json(F.struct(F.col(f"`{x}`"))) for x in df.columns])))
    ranked = m.toDF(i, s, u, c)
    ranked = ranked.join(small(many), on(ranked, many, key), "left_semi").withColumn(r, F.row_number().over(Window.partitionBy(*key).orderBy(c)))
    ranked = tmp.save(ranked.where(F.col(c) > 0), "ranked")
    two = several.alias("a").join(ranked.alias("b"), on(several, ranked, [*key, r])).select("a.*", F.col(f"b.{c}").alias(c))
    return out.unionByName(again(two))
