"""The registered stream queries over single files and over folders of part files, one file per micro-batch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorehouse.plans import views
from lorehouse.plans.catalog import oracle_sql, queries
from lorehouse.plans.check import TABLES, compare, connect

FOLDER = "/root/testdata/sf0.001"
STREAMS = sorted(n for n in queries() if n.endswith("_stream"))
ORDER = {"events": "event_id", "documents": "doc_id"}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The tables, events and documents as folders of four files that arrive one after the other."""
    folder = tmp_path_factory.mktemp("parts")
    for name in TABLES:
        source = f"{FOLDER}/{name}.parquet"
        if name not in ORDER:
            (folder / f"{name}.parquet").symlink_to(source)
            continue
        rows = spark.read.parquet(source)
        last = rows.agg(F.max(ORDER[name])).first()[0] + 1
        quarter = F.floor(F.col(ORDER[name]) * 4 / last)
        for k in range(4):
            rows.where(quarter == k).coalesce(1).write.mode("append").parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("shape", ["file", "folder"])
@pytest.mark.parametrize("name", STREAMS)
def test_stream_matches_sql(spark, parts, monkeypatch, name, shape):
    monkeypatch.setattr(views, "TRIGGER_FILES", 1)
    line, same = compare(spark, connect(FOLDER), FOLDER if shape == "file" else parts, name, queries()[name], oracle_sql()[name])
    assert same, line
