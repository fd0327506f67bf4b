"""URL filters: host and path rules first, then a weighted vocabulary that an Aho-Corasick automaton counts.

strict terms reject alone; soft terms reject when `soft_limit` different ones occur. A term counts only between
boundaries: no ASCII letter or digit may touch it. Both lists are parameters. The default is a general
vocabulary of adult, gambling, drug, piracy and fraud words: strict ones hardly occur in harmless urls, soft ones do.
"""

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

STRICT = tuple("""porn porno pornstar pornhub xxx xnxx xvideos hentai milf nsfw camgirl camgirls camsex sexcam sexcams sexchat sexshop escort escorts callgirls striptease erotic erotica bdsm upskirt incest
gambling bets sportsbook bookmaker bookmakers blackjack roulette baccarat
viagra cialis levitra xanax tramadol phentermine kamagra pills
warez keygen keygens nulled crackz serialz
spam spammer spammers phishing malware spyware ransomware botnet carding fullz""".split())
SOFT = tuple("""adult adults sex sexy nude nudes naked hot fetish hookup hookups dating singles swingers strip webcam webcams cams
casino casinos poker betting bet lottery lotto jackpot slots bingo wager odds bonus spins
pharmacy pharma drugs meds prescription steroids weightloss diet cbd vape
loans loan payday forex binary crypto profit earn rich cash prize winner
torrent torrents crack cracked serial hack hacks cheats proxy
replica cheap discount clickbait backlinks""".split())
#: (verdict, host, path): a rule fits its host and all subdomains, where the url's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower(s: str) -> str:
    """Lower-cases A-Z only."""
    return s.encode().translate(_LOWER).decode()


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host from after the first :// up to /, ? or #, path from there up to ? or #; both empty without ://."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, cut)
    return (lower(rest[:cut]), "") if slash < 0 else (lower(rest[:slash]), rest[slash:cut])


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of equally long ones the first in code point order."""
    best, name = None, host
    while host:
        for start, verdict in rules.get(name, ()):
            if path.startswith(start):
                key = (-len(name + start), name + start, verdict)
                best = key if best is None or key < best else best
        dot = name.find(".")
        if dot < 0:
            break
        name = name[dot + 1 :]
    return best and (best[1], best[2])


def automaton(strict, soft) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for t in map(lower, terms):
            a.add_word(t, (weight, t))
    a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, url: str | None) -> tuple[int, int]:
    """(strict occurrences, different soft terms), both between boundaries."""
    s, strict, soft = lower(url or ""), 0, set()
    for end, (weight, term) in a.iter(s):
        start = end - len(term)
        if not (start >= 0 and s[start].isascii() and s[start].isalnum()) and not (end + 1 < len(s) and s[end + 1].isascii() and s[end + 1].isalnum()):
            if weight == 2:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """Judges every url: (id, host, path, rule, verdict, strict_hits, soft_hits).

    One pass without a shuffle; the vocabulary and the rules travel with the tasks (their size is the caller's list's).
    Null urls and urls without :// have an empty host and path, fit no rule and are judged by the vocabulary (null: allow).
    Repeated rows are judged alike, one result row for each; ids may be null.
    """
    table: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in rules:
        table.setdefault(lower(host), []).append((path, verdict))
    strict, soft = tuple(strict), tuple(soft)
    schema = pa.schema([(id_col, pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_hits", pa.int64()), ("soft_hits", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            cols = [[], [], [], [], [], []]
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule = rule_for(host, path, table)
                n_strict, n_soft = hits(a, url)
                own = "block" if n_strict or n_soft >= soft_limit else "allow"
                for c, v in zip(cols, (host, path, rule and rule[0], rule[1] if rule else own, n_strict, n_soft)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:]))], schema=schema)

    return df.select(df[id_col].cast("long").alias(id_col), df[url_col].cast("string").alias("url")).mapInArrow(judge, f"{id_col} long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long")
