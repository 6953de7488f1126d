"""Command line, listings, and the streaming front end."""

import json
import sys

import pytest
from pyspark import cloudpickle
from test_engine import DEMO, Fixed, history

from sessionlode import __version__, cli, schemas
from sessionlode.operators.chunking import describe
from sessionlode.plans.index import Index
from sessionlode.sources.history import from_conversations
from sessionlode.sources.parts import parse
from sessionlode.streaming.sync import sync_stream

cloudpickle.register_pickle_by_value(sys.modules["test_engine"])


def test_dispatch():
    said = []
    assert cli.main(["version"], said.append) == 0 and said == [__version__]
    assert cli.main(["help"], said.append) == 0 and cli.main([], said.append) == 2
    assert cli.main(["no such command"], said.append) == 2


@pytest.fixture
def saved(spark, tmp_path, monkeypatch):
    rows = [*DEMO, ("prt_4", "m2", "s1", 3, 3, '{"type":"compaction","tail_start_id":"m1"}', 4)]
    h = history(spark, rows)
    for name in ("project", "session", "message", "part"):
        getattr(h, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setenv("MEMORY_SOURCE", str(tmp_path))
    monkeypatch.setenv("MEMORY_INDEX", str(tmp_path / "index"))
    monkeypatch.setenv("MEMORY_EMBED_DIM", "4")
    monkeypatch.setenv("MEMORY_EMBED_URL", "http://127.0.0.1:9")
    return tmp_path


def test_listings_and_index(saved):
    said = []
    assert cli.main(["sessions"], said.append) == 0
    assert said[0].splitlines()[:5] == ["sessions:  1", "messages:  2", "parts:     4", "projects:  1", "compacted: 1"]
    assert "/srv/garden" in said[0].splitlines()[-1] and "[100]" in said[0]
    assert cli.main(["session", "s1", "--dialog-limit", "3"], said.append) == 0
    lines = said[1].splitlines()
    assert "compacted: true (tail=m1)" in lines and lines[-1] == "... 1 more parts"
    assert lines[-2] == "[2] tool shell: valvectl list -> seven: open"
    assert cli.main(["index", "--project", "/elsewhere"], said.append) == 0 and json.loads(said[-1])["indexed"] == 0
    assert cli.main(["index"], said.append) == 0 and json.loads(said[-1])["indexed"] == 1


def test_descriptions(spark):
    from pyspark.sql import functions as F

    rows = [("text", '{"type":"text","text":"' + "x" * 120 + '"}'), ("tool", "broken"), ("patch", '{"type":"patch","files":["a","b"]}'), ("step-start", "{}"), ("compaction", '{"tail_start_id":"t"}')]
    got = [r[0] for r in spark.createDataFrame(rows, "k string, d string").select(describe(parse(F.col("d")), F.col("k"))).collect()]
    assert got == ["text: " + "x" * 100 + "...", "tool (parse error)", "patch 2 files: a, b", "step-start", "compaction (tail=t)"]


def test_conversations_as_history(spark):
    c = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    h = from_conversations(c)
    assert h.session.count() == 2 and [r["role"] for r in h.messages("1").collect()] == ["user", "assistant"]


def test_stream(spark, tmp_path):
    index = Index.open(spark, str(tmp_path / "i"), 4)
    h = history(spark, DEMO)
    h.session.write.parquet(str(tmp_path / "sessions"))
    run = lambda: sync_stream(spark, str(tmp_path / "sessions"), lambda: h, index, str(tmp_path / "c"), Fixed(), once=True).awaitTermination(120)
    run()
    assert index.chunks().count() == 3 and index.vectors().count() == 3
    version = index.manifest.version
    run()
    assert index.manifest.version == version
    newer = spark.createDataFrame([("s1", "p1", "", "", "t", "", "", "{}", 100, 500, None)], schemas.SESSION)
    newer.write.mode("append").parquet(str(tmp_path / "sessions"))
    run()
    assert index.state().first()["last_time_updated"] == 500 and index.chunks().count() == 3


def test_shared_folder(spark):
    from types import SimpleNamespace

    from sessionlode.sources.tables import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(session("yarn", "hdfs:///x")) == "hdfs:///x" and shared_dir(session("local[4]", None)).endswith("checkpoints")
    for master in ("yarn", "local-cluster[3,2,1024]", "spark://h:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))
