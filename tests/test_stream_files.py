"""st2_once_per_key: what it keeps goes to files and RocksDB, not to the driver or a heap, and every event counts once."""

from datetime import datetime
from pathlib import Path

import pytest

from quern.queries import data

STORE = "spark.sql.streaming.stateStore.providerClass"
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ROWS = [(1, datetime(2024, 1, 1)), (1, datetime(2025, 1, 1)), (2, datetime(1960, 1, 1)), (3, datetime(1970, 1, 1)), (4, None), (None, datetime(2024, 1, 1)), (None, None)]


def _events(spark, d, kind, rows):
    made = spark.createDataFrame([(i, t, 7, "view", 1.0, "{}") for i, t in rows], SCHEMA).repartition(1 if kind == "file" else 3)
    made.write.parquet(f"{d}/{'made' if kind == 'file' else 'events.parquet'}")
    if kind == "file":
        next(Path(d, "made").glob("*.parquet")).rename(Path(d, "events.parquet"))
    return str(d)


@pytest.mark.parametrize("kind", ["file", "folder"])
def test_every_event_counts_once(spark, tmp_path, kind):
    assert data.once(spark, _events(spark, tmp_path, kind, ROWS)).collect() == [(4,)]


def test_no_events(spark, tmp_path):
    assert data.once(spark, _events(spark, tmp_path, "file", [])).collect() == [(0,)]


def test_nothing_is_kept_by_the_driver(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr("quern.sources.scratch.Scratch.drop", lambda self: kept.append(Path(self.root.removeprefix("file:"))))
    out = data.once(spark, _events(spark, tmp_path, "file", ROWS))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MemoryPlan" not in plan and out.inputFiles()
    assert kept and any(kept[0].rglob("*.zip")) and not any(kept[0].rglob("*.delta"))  # as RocksDB writes, not as a heap is written
    assert spark.conf.get(STORE, None) is None
