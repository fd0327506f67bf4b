"""Personal data: patterns that count as they are, and boosted trees that choose among further candidates; SQL functions only.

High-recall generators propose spans, which may overlap. Trees score each by its format and by the words before it. They are
trained on the driver, on texts made from a seed that go through the same generators; a curve for each kind turns scores into
probabilities on other such texts, and each kind's least probability is set there for a precision. The trees become a
CASE expression, so scoring never leaves the JVM.
"""

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import found, joined, labelled, text_of

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
#: A whole run of digits with at most one separator between two, 12 to 19 of them; shorter and longer runs fail the base rule.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")
#: Further kinds: name, generator, and what a text must hold for it. Their spans may overlap.
CANDIDATES = (
    ("email_words", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?(?i:at) ?[\])] ?[A-Za-z0-9-]+(?: ?(?:[\[(] ?(?i:dot) ?[\])]|\.) ?[A-Za-z0-9-]+)+", r"[\[(] ?(?i:at) ?[\])]"),
    ("phone_local", r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
    ("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]"),
    ("phone_groups", r"(?<![0-9A-Za-z+().-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])", r"[0-9][\x20.-][0-9]{2,4}[\x20.-][0-9]{2}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}"),
    ("number", r"(?<![0-9])[0-9]{9,19}(?![0-9])", r"[0-9]{9}"),
)
CONTEXT = 24
#: Words before a span that speak for personal data of some sort, or for something else (fixed values).
CUES = {
    "cue_phone": "phone tel telephone call fax mobile cell ring whatsapp dial",
    "cue_id": "ssn social passport tax national identity personal insurance licence",
    "cue_bank": "iban bank account transfer card payee",
    "cue_mail": "mail email contact write reach address",
    "counter": "version order item page build serial part isbn ref total sum sku invoice ticket row record batch lot model figure table measured",
}
TAIL = r"[a-z]*(?:[\x20:#.=,-]{0,3}(?:number|numbers|no|nr|id|is|at|me|us|to|of)\b){0,2}[\x20:#.=,(-]*$"
CUE_PATTERNS = {name: rf"(?i)(?<![a-z])(?:{'|'.join(words.split())}){TAIL}" for name, words in CUES.items()}
FEATURES = ("kind", "length", "digits", "letters", "separators", "groups", "zero", *CUES, "luhn", "mod97", "distinct")


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    d = F.reverse(F.split(digits, ""))
    d = F.filter(d, lambda x: x != "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, 2 * x.cast("int") - 9).otherwise(2 * x.cast("int")))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(t: Column) -> dict[str, Column]:
    ip_ok = lambda x: F.forall(F.split(x["m"], r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    phone_ok = lambda x: F.length(_digits(x["m"])).between(9, 15)
    return {
        "email": labelled(found(t, EMAIL, t.contains("@")), "email", 0),
        "ip": labelled(found(t, IP, t.contains(".")), "ip", 1, ip_ok),
        "card": labelled(found(t, CARD), "card", 2, lambda x: luhn(_digits(x["m"]))),
        "phone": labelled(found(t, PHONE, t.contains("+")), "phone", 3, phone_ok),
    }


def mod97(m: Column) -> Column:
    """Whether letters and digits, the first four put last and letters read as 10 to 35, are 1 modulo 97, as in an IBAN."""
    c = F.regexp_replace(m, "[^A-Z0-9]", "")
    code = F.filter(F.split(F.concat(F.substring(c, 5, 64), F.substring(c, 1, 4)), ""), lambda x: x != "")
    one = lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(code, F.lit(0), one) == 1


def _features(t: Column, kind: int):
    """A function from a found span to its features."""
    return lambda x: _feature_row(t, x, kind)


def _feature_row(t: Column, x: Column, kind: int) -> Column:
    before = F.substring(t, F.greatest(x["s"] - CONTEXT, F.lit(0)).cast("int") + 1, F.least(x["s"], F.lit(CONTEXT)).cast("int"))
    m, digits = x["m"], _digits(x["m"])
    count = lambda c: F.length(c).cast("double")
    return F.struct(
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.lit(float(kind)).alias("kind"),
        count(m).alias("length"),
        count(digits).alias("digits"),
        count(F.regexp_replace(m, "[^A-Za-z]", "")).alias("letters"),
        count(F.regexp_replace(m, "[A-Za-z0-9]", "")).alias("separators"),
        F.regexp_count(m, F.lit("[0-9]+")).cast("double").alias("groups"),
        m.rlike(r"^\(?0").cast("double").alias("zero"),
        *[before.rlike(p).cast("double").alias(name) for name, p in CUE_PATTERNS.items()],
        F.when(F.length(digits) >= 9, luhn(digits)).otherwise(F.lit(False)).cast("double").alias("luhn"),
        F.when(m.rlike("^[A-Z]{2}"), mod97(m)).otherwise(F.lit(False)).cast("double").alias("mod97"),
        F.size(F.array_distinct(F.split(digits, ""))).cast("double").alias("distinct"),
    )


def _passes_luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def _passes_mod97(m: str) -> bool:
    c = re.sub("[^A-Z0-9]", "", m)
    return int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def candidates(text: str) -> list[tuple[int, int, int, list[float]]]:
    """(start, end, kind, features) of all generators' spans: what _feature_row() computes, for training."""
    out = []
    for k, (_, pattern, _) in enumerate(CANDIDATES):
        for m in re.finditer(pattern, text):
            v, before = m[0], text[max(0, m.start() - CONTEXT) : m.start()]
            d = re.sub("[^0-9]", "", v)
            cues = [float(bool(re.search(p, before, re.ASCII))) for p in CUE_PATTERNS.values()]
            check = float(len(d) >= 9 and _passes_luhn(d)), float(bool(re.match("[A-Z]{2}", v)) and _passes_mod97(v))
            out.append((m.start(), m.end(), k, [k, len(v), len(d), len(re.sub("[^A-Za-z]", "", v)), len(re.sub("[A-Za-z0-9]", "", v)), len(re.findall("[0-9]+", v)), float(bool(re.match(r"\(?0", v))), *cues, *check, len(set(d)) or 1]))
    return out


def _iban(rng: np.random.Generator) -> str:
    land = str(rng.choice(["DE", "FR", "GB", "ES", "IT", "NL", "PL"]))
    body = ("" if rng.random() < 0.6 else "".join(rng.choice(list("ABCDEFGHKLMNP"), 4))) + "".join(map(str, rng.integers(0, 10, int(rng.integers(12, 21)))))
    code = int("".join(str(int(x, 36)) for x in body + land + "00"))
    v = f"{land}{98 - code % 97:02}{body}"
    return v if rng.random() < 0.5 else " ".join(v[i : i + 4] for i in range(0, len(v), 4))


def _number(rng: np.random.Generator, form: str) -> str:
    """A form with its # replaced by digits, now and then all by the same one."""
    same = str(rng.integers(10)) if rng.random() < 0.03 else ""
    return "".join((same or str(rng.integers(10))) if c == "#" else c for c in form)


#: Forms of personal data with their cues and how often a cue goes before them, and of what only looks like it (fixed values).
TRUE_FORMS = (("### ### ####", "cue_phone", 0.6), ("(###) ###-####", "cue_phone", 0.5), ("###-###-####", "cue_phone", 0.6), ("0## #### ####", "cue_phone", 0.6), ("0###-###-####", "cue_phone", 0.6), ("0### ### ###", "cue_phone", 0.7), ("0## ## ## ##", "cue_phone", 0.7), ("###-##-####", "cue_id", 0.6), ("#########", "cue_id", 0.95), ("##########", "cue_bank", 0.95), ("################", "cue_bank", 0.9), ("iban", "cue_bank", 0.6), ("mail", "cue_mail", 0.5))
FALSE_FORMS = (("### ### ####", 0.9), ("###-##-####", 0.9), ("20##-0#-1# ##", 0.3), ("20##.1#.0# 1#", 0.3), ("#########", 0.5), ("1#########", 0.5), ("###############", 0.4), ("## ## ## ##", 0.5), ("### ### ### ###", 0.6), ("##-####-####-##", 0.6), ("code", 0.5), ("AB## #### #### ####", 0.6), ("aside", 0.1))


def examples(n: int, seed: int) -> list[tuple[str, tuple[int, int] | None]]:
    """Made texts, half of them with personal data, whose place is given, and half with something that looks like it.

    What a text is decides its words and forms by chance, not the other way round: cues go before look-alikes now and then, and
    both also stand without any.
    """
    rng = np.random.default_rng(seed)
    words = "the a of and river house table quick green under paper walks seldom there often market stone letter between evening".split()
    some = lambda: " ".join(rng.choice(words, int(rng.integers(2, 9))))
    name = lambda: "".join(rng.choice(list("abcdeilmnorstu"), int(rng.integers(1, 9))))
    out = []
    for _ in range(n):
        good, cue = rng.random() < 0.5, ""
        if good:
            form, group, often = TRUE_FORMS[int(rng.integers(len(TRUE_FORMS)))]
            r = rng.random()
            cue = str(rng.choice(CUES[group if r < often else "counter"].split())) if r < often or r > 0.98 else ""
        else:
            form, often = FALSE_FORMS[int(rng.integers(len(FALSE_FORMS)))]
            r = rng.random()
            group = "counter" if r < often else str(rng.choice([g for g in CUES if g != "counter"]))
            cue = str(rng.choice(CUES[group].split())) if r < often or r > 0.97 else ""
        if form == "iban":
            v = _iban(rng)
        elif form == "mail":
            at, dot = (("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (AT) ", "."))[int(rng.integers(4))]
            v = f"{name()}{rng.choice(['.', '_', ''])}{name()}{at}{name()}{dot}{rng.choice(['com', 'org', 'net', 'io'])}"
        elif form == "code":
            v = "".join(rng.choice(list("ABCDEFGH"), 2)) + _number(rng, "##") + "".join(rng.choice(list("ABCDEFGHJK0123456789"), int(rng.choice([12, 16, 20]))))
        elif form == "aside":
            v = f"looked (at) {name()}. {name()}"
        else:
            v = _number(rng, form)
        link = str(rng.choice([" ", ": ", " number ", " no. ", " is ", " #"])) if cue else " "
        before = f"{some()} {cue}{link}"
        out.append((f"{before}{v} {some()}.", (len(before), len(before) + len(v)) if good else None))
    return out


def rows_of(texts: list[tuple[str, tuple[int, int] | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the generators' spans in made texts, and whether each covers the personal data but for a character at its ends;
    of generators that do, the first one, the most special, is right."""
    x, y = [], []
    for text, place in texts:
        open_ = place is not None
        for s, e, _, row in candidates(text):
            x.append(row)
            y.append(float(open_ and abs(s - place[0]) <= 1 and abs(e - place[1]) <= 1))
            open_ = open_ and not y[-1]
    return np.array(x, float), np.array(y)


def _stump_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple | None:
    best = None
    base = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 19))):
            left = rows[x[rows, f] <= t]
            if 10 <= len(left) <= len(rows) - 10:
                right = rows[x[rows, f] > t]
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - base
                if best is None or gain > best[0]:
                    best = (gain, f, float(t), left, right)
    return best


def _grow(x, g, h, rows, depth, rate):
    cut = _stump_split(x, g, h, rows) if depth else None
    if cut is None or cut[0] < 1e-3:
        return float(rate * g[rows].sum() / (h[rows].sum() + 1))
    _, f, t, left, right = cut
    return (f, t, _grow(x, g, h, left, depth - 1, rate), _grow(x, g, h, right, depth - 1, rate))


def predict(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@lru_cache(maxsize=4)
def train(n: int = 6000, seed: int = 11, trees: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.9) -> tuple[tuple, tuple, tuple, tuple]:
    """(trees, slopes, offsets, least probabilities), the last three one for each kind: gradient boosting on the logistic loss, then
    on other texts a logistic curve of each kind's score, and the least probability, one half or more,
    from which that share of spans is right."""
    x, y = rows_of(examples(n, seed))
    score, forest = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate)
        forest.append(tree)
        score += [predict(tree, r) for r in x]
    hx, hy = rows_of(examples(n, seed + 1))
    held = np.array([sum(predict(t, r) for t in forest) for r in hx])
    slopes, offsets, least = [], [], []
    for k in range(len(CANDIDATES)):
        s, t = held[hx[:, 0] == k], hy[hx[:, 0] == k]
        w = np.array([1.0, 0.0])
        z = np.stack([s, np.ones_like(s)], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (t - p) - 1e-2 * w)
        p = np.round(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 6)
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(t[order]) / np.arange(1, len(p) + 1)
        last = np.r_[p[order][1:] != p[order][:-1], True] if len(p) else np.empty(0, bool)  # of equal probabilities
        ok = np.flatnonzero(last & (share >= precision))
        slopes.append(round(float(w[0]), 6))
        offsets.append(round(float(w[1]), 6))
        least.append(max(0.5, float(p[order][ok[-1]])) if len(ok) else 2.0)
    return tuple(forest), tuple(slopes), tuple(offsets), tuple(least)


def _score(forest: tuple, c: Column) -> Column:
    def walk(tree) -> Column:
        return F.lit(tree) if isinstance(tree, float) else F.when(c[FEATURES[tree[0]]] <= F.lit(tree[1]), walk(tree[2])).otherwise(walk(tree[3]))

    total = F.lit(0.0)
    for tree in forest:
        total = total + walk(tree)
    return total


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **training) -> DataFrame:
    """(doc_id, email, ip, card, phone, more), one row for each input row; each an array of spans in code points.

    Base kinds hold all of their matches. `more` holds candidates that reach the least probability of their kind, touch no base span
    and are beaten by no overlapping candidate (by probability, then length, then start, then kind). Null and empty texts have
    no spans; repeated rows and null ids are judged alike, texts of any length as a whole; an empty table gives an empty one.
    Further columns of any name are not read.
    """
    forest, slopes, offsets, least = train(**training)
    t = F.col("text")
    d = df.select(df[id_col].alias("doc_id"), text_of(text_col).alias("text"))
    numeric = t.rlike("[0-9]{2}")
    more = []
    for i, (name, regex, gate) in enumerate(CANDIDATES):
        spans = found(t, regex, t.rlike(gate) if name == "email_words" else numeric & t.rlike(gate))
        more.append(F.transform(spans, _features(t, i)))
    d = d.select("doc_id", *[c.alias(k) for k, c in base_spans(t).items()], F.concat(*more).alias("c"))
    of = lambda values, c: F.get(F.array(*map(F.lit, values)), c["kind"].cast("int"))
    part = F.transform("c", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), _score(forest, c).alias("z")))
    d = d.withColumn("c", F.when(F.size("c") > 0, part).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,kind:double,z:double>>")))
    odds = lambda c: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), of(slopes, c) * c["z"] + of(offsets, c)))
    d = d.withColumn("c", F.transform("c", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), F.round(1 / (1 + F.exp(-odds(c))), 6).alias("score"))))
    d = d.withColumn("c", F.filter("c", lambda c: c["score"] >= of(least, c)))
    base = F.concat(*BASE)
    touch = lambda a, b: (a["s"] < b["e"]) & (b["s"] < a["e"])
    beats = lambda a, b: F.struct(a["score"], a["e"] - a["s"], -a["s"], -a["kind"]) > F.struct(b["score"], b["e"] - b["s"], -b["s"], -b["kind"])
    d = d.withColumn("c", F.filter("c", lambda c: ~F.exists(base, lambda b: touch(b, c))))
    d = d.withColumn("c", F.filter("c", lambda c: ~F.exists(F.col("c"), lambda o: touch(o, c) & beats(o, c))))
    names = F.array(*[F.lit(n) for n, _, _ in CANDIDATES])
    spans = F.transform("c", lambda c: F.struct(c["s"].alias("s"), (F.lit(len(BASE)) + c["kind"].cast("int")).alias("k"), c["e"].alias("e"), F.get(names, c["kind"].cast("int")).alias("kind")))
    return d.select("doc_id", *BASE, spans.alias("more"))


def redact(text: Column, spans: Column, mark: str = "[redacted]") -> Column:
    """The text with each span replaced; spans as in find(), overlapping ones merged from the left."""
    kind = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s, e = F.greatest(x["s"], acc["at"]), F.greatest(x["e"], acc["at"])
        gap = F.substring(text, acc["at"].cast("int") + 1, (s - acc["at"]).cast("int"))
        return F.struct(e.alias("at"), F.concat(acc["out"], gap, F.when(e > s, F.lit(mark)).otherwise(F.lit(""))).alias("out"))

    return F.aggregate(F.array_sort(spans), kind, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))


def digest(rows: DataFrame) -> DataFrame:
    base = F.concat(*BASE)
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, "more")).alias("spans"),
    )
