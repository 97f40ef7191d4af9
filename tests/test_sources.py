"""Data sources over a web made up here: partitions by host, pauses by a clock made up here, offsets, tries of an index."""

import pytest

from factloom.sources import datasource as D
from factloom.sources import web
from tests import fake_web

URLS = ["https://www.a.org/1", "https://a.org/2", "https://strict.org/secret/x", "https://strict.org/open", "https://tls.org/p", "https://down.org/p", "https://a.org/2"]


@pytest.fixture
def clock(monkeypatch):
    """Time passes only in sleeps."""
    class Clock:
        now, slept = 1000.0, []

        def sleep(self, s):
            self.slept.append(round(s, 6))
            self.now += s

    c = Clock()
    c.slept = []
    for module in (web, D):
        monkeypatch.setattr(module.time, "sleep", c.sleep)
    monkeypatch.setattr(web.time, "monotonic", lambda: c.now)
    fake_web.CALLS.clear()
    return c


def test_hosts_are_partitions():
    parts = D.by_host(URLS)
    assert [(p.host, p.urls) for p in parts] == [("a.org", ("https://a.org/2", "https://www.a.org/1")), ("down.org", ("https://down.org/p",)), ("strict.org", ("https://strict.org/open", "https://strict.org/secret/x")), ("tls.org", ("https://tls.org/p",))]


def test_pauses_and_tries(clock):
    """A second between requests to a host, robots.txt included; a host without answer is asked again after a wait."""
    options = {"transport": "tests.fake_web:transport", "delay": "1.0", "tries": "3", "backoff": "5"}
    rows = list(D.asked(D.HostPart("a.org", ["https://a.org/1", "https://a.org/2"]), options))
    assert [r[2] for r in rows] == [True, True] and clock.slept == [1.0, 1.0]
    clock.slept.clear()
    (row,) = D.asked(D.HostPart("down.org", ["https://down.org/p"]), options)
    assert row[1:3] == (0, False) and row[5] == "no answer" and clock.slept == [1.0, 5.0, 10.0]


def test_index_is_asked_three_times(clock):
    assert D.index_stamps(fake_web.index, "https://known.org") == ["20240101000000", "20250101000000"] and clock.slept == []
    assert D.index_stamps(fake_web.index, "https://busy.org") == ["20250102000000"] and clock.slept == [10.0, 20.0]
    clock.slept.clear()
    assert D.index_stamps(fake_web.index, "https://broken.org") == [] and clock.slept == [10.0, 20.0, 30.0]


def test_batch_source(spark):
    D.register(spark)
    got = spark.read.format("pages").option("list", " ".join(URLS)).option("transport", "tests.fake_web:transport").option("fallback", "tests.fake_web:fallback").option("delay", 0).option("backoff", 0).load()
    assert got.rdd.getNumPartitions() == 4
    rows = {r.url: (r.status, r.ok, r.error) for r in got.collect()}
    assert rows == {
        "https://www.a.org/1": (200, True, None), "https://a.org/2": (200, True, None), "https://strict.org/open": (200, True, None), "https://tls.org/p": (200, True, None),
        "https://strict.org/secret/x": (0, False, "blocked by robots.txt"), "https://down.org/p": (0, False, "no answer"),
    }


def test_versions_source(spark):
    D.register(spark)
    got = spark.read.format("archive_versions").option("list", "https://known.org https://gone.org").option("transport", "tests.fake_web:index").option("wait", 0).load()
    assert sorted(map(tuple, got.collect())) == [("https://known.org", "20240101000000"), ("https://known.org", "20250101000000")]


def test_stream_source(spark, tmp_path):
    """Batches of two addresses; a stream that starts again goes on where its checkpoint says."""
    D.register(spark)
    (tmp_path / "list.txt").write_text("\n".join(URLS[:4]) + "\n")

    def run() -> None:
        stream = spark.readStream.format("pages").option("addresses", f"file://{tmp_path}/list.txt").option("transport", "tests.fake_web:transport").option("delay", 0).option("batch", 2).load()
        query = stream.select("url", "status").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").start(f"file://{tmp_path}/out")
        query.processAllAvailable()
        query.stop()

    run()
    assert sorted(r.url for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == sorted(URLS[:4])
    with (tmp_path / "list.txt").open("a") as f:
        f.write("https://b.org/new\n")
    run()
    assert sorted(r.url for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == sorted([*URLS[:4], "https://b.org/new"])
