"""Quality rules as a bitmask ledger, in SQL functions only.

Every rule is evaluated once; the ledger keeps each document's measurements and one failure bit a rule. A policy is a
version with a mask of the rules that it enforces, so another policy, or the effect of leaving one rule out, is a bitwise
operation on the ledger and never another pass over the texts.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, UPPER, text_of, words

SYMBOLS = "#*$%&|<>"
_LOW = 20  #: bits of a packed window that hold its position


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": (10 * c("n_dup_lines") > 3 * c("n_lines")) & (c("n_dup_lines") >= 3),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
        "shouting": 2 * c("n_upper") > c("word_chars"),
        "exclaiming": 2 * c("n_exclaim") > c("n_words"),
    }


RULES = ("too_few_words", "repeated_windows", "symbols", "repeated_lines", "short_words", "long_words", "shouting", "exclaiming")
BITS = {r: i for i, r in enumerate(RULES)}
BASE = Policy(1, RULES[:2])
STANDARD = Policy(2, RULES)


def _covered(positions: Column) -> Column:
    """Words that 3-word windows at these sorted positions cover."""
    gaps = F.transform(positions, lambda p, i: F.when(i == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), p - F.get(positions, i - 1))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)


def _high(x: Column) -> Column:
    return F.shiftright(x, _LOW)


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_exclaim), one row for each input row.

    Repeated windows are found inside the row: sorted by hash with the position in the low bits, which needs neither an
    exploded row a window nor a shuffle. Where two different 64-bit hashes of a text agree in the bits that are kept (or it
    has over 2**20 words), pairs of hash and position are sorted instead, so the count never depends on the packing.
    """
    t = F.col("text")
    d = df.select(df[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    d = d.withColumn("w", words(t))
    d = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.translate(t, UPPER, ""))).cast("long").alias("n_upper"),
        (F.length(t) - F.length(F.translate(t, "!", ""))).cast("long").alias("n_exclaim"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    h, v = F.col("h"), F.col("v")
    d = d.select(
        *[c for c in d.columns if c not in ("h", "lines")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(h) >= 3, F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), F.lit(1), F.size(h) - 2)).otherwise(F.array().cast("array<bigint>")).alias("v"),
    )
    d = d.withColumn("n_different", F.size(F.array_distinct(v)))
    exact = (F.size(v) < (1 << _LOW)) & (F.size(F.array_distinct(F.transform(v, _high))) == F.col("n_different"))
    d = d.withColumn("how", F.when(F.size(v) == F.col("n_different"), F.lit(0)).when(exact, F.lit(1)).otherwise(F.lit(2)))
    d = d.withColumn("p", F.when(F.col("how") == 1, F.sort_array(F.transform(v, lambda x, i: F.shiftleft(_high(x), _LOW).bitwiseOR(i.cast("long"))))))
    d = d.withColumn("q", F.when(F.col("how") == 2, F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))))))
    p, q = F.col("p"), F.col("q")
    at = F.transform(
        F.filter(p, lambda x, i: F.coalesce(_high(x) == _high(F.get(p, i - 1)), F.lit(False)) | F.coalesce(_high(x) == _high(F.get(p, i + 1)), F.lit(False))),
        lambda x: x.bitwiseAND(F.lit((1 << _LOW) - 1).cast("long")),
    )
    at2 = F.transform(F.filter(q, lambda x, i: F.coalesce(x["x"] == F.get(q, i - 1)["x"], F.lit(False)) | F.coalesce(x["x"] == F.get(q, i + 1)["x"], F.lit(False))), lambda x: x["i"])
    d = d.withColumn("at", F.sort_array(F.when(F.col("how") == 1, at).when(F.col("how") == 2, at2).otherwise(F.array().cast("array<bigint>"))))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("at")).alias("n_repeat_words"), "n_lines", "n_upper", "n_exclaim")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """measure() with failed: bit BITS[rule] is set where the rule fails. Empty texts have no words and fail too_few_words."""
    bits = F.lit(0).cast("long")
    for name, cond in _rules().items():
        bits = bits.bitwiseOR(F.when(cond, F.lit(1 << BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(df, id_col, text_col).withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """Adds kept, base_failed and policy_version to a ledger."""
    held = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0
    base = F.col("failed").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    return rows.withColumns({"base_failed": base, "kept": held & ~base, "policy_version": F.lit(policy.version)})


def ablate(rows: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """One row for each rule of the policy: documents that it fails, and those that only it fails (kept again without it).

    Documents are first counted by their failure bits; there are at most 2**len(RULES) different ones.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    one = counts.select("bits", "n", each)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return one.groupBy(F.col("r.rule").alias("rule")).agg(n(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"), n(F.col("bits") == F.col("r.bit")).alias("n_only"))
