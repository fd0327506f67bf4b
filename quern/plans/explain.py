"""Plans as rows: Spark's formatted explanation and what the execution counted."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def explained(df: DataFrame, mode: str = "formatted") -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def operators(df: DataFrame) -> list[tuple[int, str]]:
    """(depth, operator) of the physical plan, from the root."""
    text = explained(df).split("== Physical Plan ==")[-1].split("\n\n")[0]
    rows = []
    for line in text.splitlines():
        m = re.match(r"^([\s:]*(?:\+-|:-)?\s*)(?:\* )?(\w[\w ]*?)(?: \((\d+)\))?$", line.rstrip())
        if m and m[2]:
            rows.append((len(m[1]) // 3, m[2].strip()))
    return rows


def scans(df: DataFrame) -> list[dict[str, str]]:
    """What each file scan reads and which filters it takes."""
    text, out = explained(df), []
    for block in re.split(r"\n\n+", text):
        if re.match(r"\(\d+\) Scan ", block):
            get = lambda k: (re.search(rf"{k}: \[?(.*?)\]?(?:\n|$)", block) or ["", ""])[1]  # noqa: B023,E731
            out.append({"pushed": get("PushedFilters"), "partition": get("PartitionFilters"), "schema": get("ReadSchema")})
    return out


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The frame with an observer of its row count, which is known after the next action."""
    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows")), o
