import json

import pytest

from rangeflow.plans import config
from rangeflow.plans.checkpoint import Checkpoint, CheckpointError
from rangeflow.plans.planner import TokenRange, split_range
from rangeflow.plans.progress import Metrics, Throttle, backoff_ms, notification, with_retries


def test_throttle():
    assert Throttle(64).observe(5) == 68
    assert Throttle(100).observe(25) == 80
    assert Throttle(8, 8, 512).observe(99) == 8 and Throttle(512, 8, 512).observe(1) == 512 and Throttle(64).observe(12) == 64
    with pytest.raises(ValueError):
        Throttle(4, 8, 16)


def test_backoff_and_retries():
    assert [backoff_ms(k, 100, 1000) for k in range(1, 8)] == [0, 100, 200, 400, 800, 1000, 1000]
    left = [OSError(), OSError()]
    waits = []

    def work():
        if left:
            raise left.pop()
        return "done"

    assert with_retries(work, sleep=waits.append) == "done" and len(waits) == 3
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=waits.append)


@pytest.fixture
def store(tmp_path):
    now = [1000.0]
    found = Checkpoint(str(tmp_path / "run.db"), clock=lambda: now[0])
    found.now = now
    return found


def test_checkpoint_states(store):
    key = store.create_run("r", "a.b", "t", "p", split_range(TokenRange(0, 40), 4))
    first = store.claim(key, "w1")
    assert (first["token_start"], first["attempts"]) == (0, 1)
    assert store.claim(key, "w2")["token_start"] == 10
    with pytest.raises(CheckpointError):
        store.complete(key, 0)  # no progress was saved
    store.save_progress(key, 0, 5, 5, 50, 9)
    store.complete(key, 0, "out")
    for again in (lambda: store.fail(key, 0, "x"), lambda: store.save_progress(key, 0, 1, 1, 1), lambda: store.complete(key, 2)):
        with pytest.raises(CheckpointError):
            again()
    store.fail(key, 1, "boom")
    assert store.summary(key) == {"pending": 2, "running": 0, "completed": 1, "failed": 1, "total": 4, "rows_read": 5, "rows_written": 5, "bytes_written": 50}
    assert [u["unit"] for u in store.units(key, "pending", "running", "failed")] == [1, 2, 3] and not store.finish_if_done(key)
    assert store.requeue_failed(key) == 1
    while u := store.claim(key, "w"):
        store.save_progress(key, u["unit"], 1, 1, 1)
        store.complete(key, u["unit"])
    assert store.finish_if_done(key) and store.run(key)["status"] == "completed"


def test_a_second_attempt_must_save_its_own_progress(store):
    key = store.create_run("r", "a.b", "t", "p", [TokenRange(0, 1)])
    store.claim(key, "w")
    store.save_progress(key, 0, 1, 1, 1)
    store.fail(key, 0, "x")
    store.requeue_failed(key)
    assert store.claim(key, "w")["attempts"] == 2
    with pytest.raises(CheckpointError):
        store.complete(key, 0)


def test_leases(store):
    key = store.create_run("r", "a.b", "t", "p", split_range(TokenRange(0, 2), 2))
    store.claim(key, "gone")
    store.now[0] += 100
    store.claim(key, "alive")
    store.now[0] += 60
    assert store.reclaim_stale(key, 120) == 1
    assert [u["state"] for u in store.units(key)] == ["pending", "running"]


CONFIG = """
[migration]
name = "m"
[source]
path = "/s"
[target]
path = "/t"
[[tables]]
source = "a.b"
target = "c.d"
partition_key = ["k"]
"""


def test_vnode_is_refused():
    with pytest.raises(config.ConfigError, match="topology"):
        config.parse(CONFIG + "[planner]\nmode = 'vnode'")


def test_config():
    c = config.parse(CONFIG)
    assert (c.units, c.engine.page_size, c.engine.write_batch_size, c.concurrency.initial, c.validation.sample_size, c.live.window_secs) == (512, 5000, 10, 64, 1000, 60)
    assert c.mapping("a.b").target == "c.d" and c.mapping("x.y").target == "x.y"
    for more in ("[engine]\nwrite_batch_size = 257", "[engine]\nmax_units = 0", "[concurrency]\nmin = 100", "[integrity]\nfail_closed = false", "[planner]\nmode = 'x'", "[engine]\nbogus = 1", "[bogus]\na = 1", "[checkpoint]\ninterval_secs = 0", "[validation]\nmode = 'x'", "[live]\nstart_at = 'soon'", "[engine]\npreserve_elements = true"):
        with pytest.raises(config.ConfigError):
            config.parse(CONFIG + more)
    with pytest.raises(config.ConfigError):
        config.parse(CONFIG.replace('"m"', '" "'))
    with pytest.raises(config.ConfigError):
        config.split_name("plain")
    assert config.parse_time("1970-01-01T00:00:01Z") == 1_000_000 and config.parse_time("1960-01-01T00:00:00+00:00") == 0


def test_metrics_and_notification():
    text = Metrics(rows_read=3, target_latency_ms=[0.5, 3.0]).exposition()
    assert "rangeflow_rows_read_total 3" in text and 'rangeflow_target_latency_ms_bucket{le="4"} 2' in text and text.endswith("# EOF\n")
    assert json.loads(notification("r", "failed", {"total": 4}, 1.5, "x")) == {"run": "r", "status": "failed", "elapsed_seconds": 1.5, "total": 4, "error": "x"}


def test_eta(spark):
    from pyspark.sql import functions as F

    from rangeflow.plans.progress import eta_seconds

    found = spark.createDataFrame([(50.0, 100.0), (0.5, 10.0), (100.0, 10.0), (20.0, 0.5)], "p double, e double").select(eta_seconds(F.col("p"), F.col("e")))
    assert [r[0] for r in found.collect()] == [100.0, None, None, None]


def test_a_lost_attempt_changes_nothing(tmp_path):
    now = [100.0]
    store = Checkpoint(str(tmp_path / "f.db"), lambda: now[0])
    key = store.create_run("r", "a.b", "a.b", "p", split_range(TokenRange(0, 10), 1))
    first = store.claim(key, "slow")
    now[0] += 500
    assert store.reclaim_stale(key, 120) == 1
    second = store.claim(key, "quick")
    assert (first["attempts"], second["attempts"]) == (1, 2)
    lost = ("slow", 1)
    for late in (lambda: store.save_progress(key, 0, 1, 1, 1, None, lost), lambda: store.complete(key, 0, "x", lost), lambda: store.fail(key, 0, "x", lost)):
        with pytest.raises(CheckpointError):
            late()
    store.save_progress(key, 0, 1, 1, 1, None, ("quick", 2))
    store.complete(key, 0, "out", ("quick", 2))


def test_heartbeats_keep_units(tmp_path):
    import time

    store = Checkpoint(str(tmp_path / "h.db"))
    key = store.create_run("r", "a.b", "a.b", "p", split_range(TokenRange(0, 10), 2))
    store.claim(key, "w")
    with store.beating(key, "w", 0.05):
        time.sleep(0.6)
        assert store.reclaim_stale(key, 0.4) == 0
    time.sleep(0.6)
    assert store.reclaim_stale(key, 0.4) == 1


def test_settings_without_meaning_are_refused():
    for section in ('[engine]\npage_size = 10', '[planner]\nmode = "vnode"', '[planner]\nmode = "other"', '[engine]\nattempts = 0'):
        with pytest.raises(config.ConfigError):
            config.parse(CONFIG + "\n" + section)
    assert config.parse(CONFIG + '\n[planner]\nmode = "vnode"\ntokens = [1, 5]').planner.tokens == (1, 5)
