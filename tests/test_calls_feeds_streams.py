"""Calls with limits, the feed source, sliding windows and the retry stream, beyond what the named queries show."""

import datetime as dt
import os
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trellis.functions import answers as A
from trellis.operators import calls
from trellis.operators import evaluation as E
from trellis.sources import feed_source
from trellis.streaming import incremental as I
from trellis.streaming import retries
from trellis.streaming import sliding as S


def odd_call(k):
    if k == 1:
        raise KeyError("one")
    if k == 2:
        time.sleep(60)
    if k == 3:
        os._exit(1)
    return None if k == 4 else f"v{k}"


def test_calls_that_fail_hang_or_end_their_process(spark):
    timings = calls.Timings(spark)
    rows = spark.range(8).withColumn("seconds", F.lit("old")).repartition(2)
    began = time.time()
    out = calls.with_calls(rows, odd_call, ["id"], 0.7, timings=timings).collect()
    got = {r.id: (r.value, r.reason) for r in out}
    assert got == {0: ("v0", None), 1: (None, "KeyError: 'one'"), 2: (None, "timeout after 0.7 s"), 3: (None, "the call's process ended"), 4: (None, None), **{k: (f"v{k}", None) for k in (5, 6, 7)}}
    assert time.time() - began < 30 and all(r.seconds >= 0 for r in out)
    found = timings.values()
    assert (found["calls"], found["timeouts"], found["failures"]) == (8, 1, 2) and found["seconds"] >= 0.7
    assert calls.with_calls(rows.limit(0), odd_call, ["id"], 1.0).count() == 0


def test_a_call_without_inputs_and_of_another_type(spark):
    out = calls.with_calls(spark.range(3), lambda: [1, 2], [], 2.0, "array<int>", out="pair").collect()
    assert [list(r.pair) for r in out] == [[1, 2]] * 3 and all(r.reason is None for r in out)


def test_calls_that_wait_do_so_together(spark):
    """Twenty calls of 1 s that hang beside others: some are waited for at once, and each row has its own outcome."""

    def some_hang(k):
        if k % 5 == 2:
            time.sleep(60)
        if k % 25 == 3:
            os._exit(1)
        return k

    began = time.time()
    out = calls.with_calls(spark.range(100).coalesce(1), some_hang, ["id"], 1.0, "long", together=10).collect()
    assert time.time() - began < 15 and [r.id for r in out] == list(range(100))
    want = lambda k: (None, "timeout after 1 s") if k % 5 == 2 else (None, calls.ENDED) if k % 25 == 3 else (k, None)
    assert [(r.value, r.reason) for r in out] == [want(k) for k in range(100)] and all(r.seconds < 3 for r in out)


# ---- feeds ------------------------------------------------------------------------------------


def test_a_feed_that_fails_for_a_while_loses_and_repeats_nothing(spark, tmp_path):
    feeds = {k: tmp_path / k for k in ("a", "b")}

    def add(k, *titles):
        feeds[k].mkdir(exist_ok=True)
        (feeds[k] / f"{len(list(feeds[k].iterdir())):03d}").write_text("\n".join(f"<item><title>{x}</title></item>" for x in titles))

    def poll():
        stream = feed_source.read_feeds(spark, [str(p) for p in feeds.values()], "trellis.sources.feed_source:StoredFeeds", stream=True)
        I.append_results(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
        rows = spark.read.schema(feed_source.SCHEMA).parquet(f"{tmp_path}/out").collect()
        return sorted((os.path.basename(r.source), r.position, r.title) for r in rows if r.title), sum(r.reason is not None for r in rows)

    add("a", "1", "2")
    assert poll() == ([("a", 0, "1"), ("a", 1, "2")], 1)  # b is not there yet
    add("b", "x")
    assert poll() == ([("a", 0, "1"), ("a", 1, "2"), ("b", 0, "x")], 1)
    add("a", "3")
    got, failures = poll()
    assert got == [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 0, "x")] and failures == 1
    assert poll() == (got, 1)  # nothing new


class SlowFeeds:
    def count(self, address):
        return 1

    def fetch(self, address):
        if address == "slow":
            time.sleep(60)
        return b"<rss><item><title>quick</title></item></rss>"


def test_a_slow_feed_is_a_row(spark):
    rows = feed_source.read_feeds(spark, ["quick", "slow"], "tests.test_calls_feeds_streams:SlowFeeds", 0.8).collect()
    assert {(r.source, r.title, r.reason) for r in rows} == {("quick", "quick", None), ("slow", None, "timeout after 0.8 s")}


def test_offsets_of_feeds():
    reader = feed_source.FeedStreamReader({"addresses": "a\nb", "fetcher": "tests.test_calls_feeds_streams:SlowFeeds", "seconds": "2"})
    assert reader.initialOffset() == {"a": [0, 0], "b": [0, 0]}
    end = reader.latestOffset()
    assert end == {"a": [1, 0], "b": [1, 0]}
    assert [(p.address, p.begin, p.end) for p in reader.partitions({"a": [0, 0], "b": [1, 0]}, end)] == [("a", 0, 1)]
    assert [(p.address, p.begin, p.end) for p in reader.partitions({"a": [5, 0]}, {"a": [5, 1], "b": [-1, 1]})] == [("a", 5, 5), ("b", 0, None)]


# ---- sliding windows --------------------------------------------------------------------------


@pytest.mark.parametrize("width,slide", [("1 hour", "20 minutes"), ("50 minutes", "15 minutes"), ("1 hour", "1 hour")])
def test_panes_add_up_to_windows(spark, width, slide):
    start = dt.datetime(2024, 3, 30, 22)
    rows = [(start + dt.timedelta(minutes=7 * i % 331, seconds=i), "ab"[i % 2], float(i)) for i in range(200)] + [(None, "a", 1.0), (start, "a", None)]
    w, s = (dt.timedelta(microseconds=S.microseconds(x)) for x in (width, slide))
    want = defaultdict(list)
    for at, k, v in rows:
        if at is not None:
            begin = dt.datetime(1970, 1, 1) + (at - dt.datetime(1970, 1, 1)) // s * s
            while begin + w > at:
                want[begin, k].append(v)
                begin -= s
    got = {(r.window_start, r.k): (r.window_end - r.window_start, r.n, r.total, r.most) for r in S.sliding(spark.createDataFrame(rows, "ts timestamp, k string, v double"), "ts", width, slide, ["k"], "v").collect()}
    some = lambda vs: [v for v in vs if v is not None]
    assert got == {key: (w, len(vs), sum(some(vs)) if some(vs) else None, max(some(vs), default=None)) for key, vs in want.items()}


def test_windows_that_cannot_be(spark):
    assert S.pane_of("1 hour 30 minutes", "1 hour") == f"{30 * 60 * 10**6} microseconds"
    for bad in (("1 month", "1 day"), ("1 hour", "2 hours"), ("x", "1 hour")):
        with pytest.raises(ValueError):
            S.pane_of(*bad)


# ---- retries ----------------------------------------------------------------------------------


def test_questions_are_decided_once(spark, tmp_path):
    """Answers, surrender, silence (a timer), repeated and unusual rows, over stops."""
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    files = [
        [("q1", at(1), False, "no"), ("q2", at(1), True, "x"), ("q3", at(1), False, "a"), ("q3", at(1, 1), None, "b"), ("q5", at(1), False, "only"), (None, at(1), True, None)],
        [("q1", at(1, 30), True, "y"), ("q3", at(1, 40), False, "c"), ("q2", at(1, 50), True, "again"), ("q6", None, True, "no time")],
        [("q4", at(5), False, "late"), ("q3", at(5), True, "too late"), ("q4", at(5, 30), False, "later"), ("q4", at(9), True, "after the silence")],
        [("q9", at(15), True, "end")],
    ]
    schema = "question string, ts timestamp, passed boolean, feedback string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        with retries.rocksdb_state(spark):
            query = I.append_results(retries.outcomes(stream, 3, 3_600_000), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
    got = {r.question: (r.attempts, r.outcome, r.feedback, r.decided) for r in spark.read.schema(retries.OUT).parquet(f"{tmp_path}/out").collect()}
    assert got == {
        "q1": (2, "answered", None, at(1, 30)), "q2": (1, "answered", None, at(1)), "q3": (3, "given up", "c", at(1, 40)), "q4": (2, "expired", "later", at(6, 30)),
        "q5": (1, "expired", "only", at(2)), "": (1, "answered", None, at(1)), "q9": (1, "answered", None, at(15)),
    }


@pytest.mark.parametrize("again", [False, True])
def test_questions_of_a_whole_batch_are_decided_at_once(spark, tmp_path, again):
    """decide_into: the same outcomes, over stops, and over a last micro-batch that is run again."""
    at = lambda h, m=0: dt.datetime(2024, 5, 1, h, m)
    files = [
        [("q1", at(1), False, "no"), ("q2", at(1), True, "x"), ("q3", at(1), False, "a"), ("q3", at(1, 1), None, "b"), ("q5", at(1), False, "only"), (None, at(1), True, None)],
        [("q1", at(1, 30), True, "y"), ("q3", at(1, 40), False, "c"), ("q2", at(1, 50), True, "again"), ("q6", None, True, "no time")],
        [("q4", at(5), False, "late"), ("q3", at(5), True, "too late"), ("q4", at(5, 30), False, "later"), ("q4", at(9), True, "after the silence"), ("q7", at(1, 5), True, "late rows are dropped")],
        [("q9", at(15), True, "end")],
    ]
    schema = "question string, ts timestamp, passed boolean, feedback string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        retries.decide_into(stream, f"{tmp_path}/decided", f"{tmp_path}/checkpoint").awaitTermination()
    if again:
        os.remove(f"{tmp_path}/checkpoint/commits/3")
        (tmp_path / "checkpoint" / "commits" / ".3.crc").unlink(missing_ok=True)
        retries.decide_into(stream, f"{tmp_path}/decided", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.question: (r.attempts, r.outcome, r.feedback, r.decided) for r in retries.read_decided(spark, f"{tmp_path}/decided").collect()}
    assert got == {
        "q1": (2, "answered", None, at(1, 30)), "q2": (1, "answered", None, at(1)), "q3": (3, "given up", "c", at(1, 40)), "q4": (2, "expired", "later", at(6, 30)),
        "q5": (1, "expired", "only", at(2)), "": (1, "answered", None, at(1)), "q9": (1, "answered", None, at(15)),
    }
    assert retries.read_decided(spark, f"{tmp_path}/nothing").count() == 0


# ---- judgements and canonical JSON --------------------------------------------------------------


def test_judgements(spark):
    replies = {
        None: "no object", "": "no object", '{"groundedness": 1, "completeness": 1, "relevance": 1}': None, '{"groundedness": NaN, "completeness": 1, "relevance": 1}': "no JSON",
        '{"groundedness": "0.5", "completeness": 1e-1, "relevance": -0.1}': "relevance is out of range", '{"groundedness": {"a": 1}, "completeness": 1, "relevance": 1}': "groundedness is no number",
    }
    got = spark.createDataFrame([(x,) for x in replies], "r string").select("r", A.judge_scores(F.col("r")).alias("s")).collect()
    assert {r.r: r.s.error for r in got} == replies and all((r.s.groundedness is None) == (r.s.error is not None) for r in got)


def test_canonical_json_at_any_depth(spark):
    df = spark.sql("SELECT map('b', named_struct('y', array(map('k', 2, 'a', CAST(NULL AS INT))), 'x', 1), 'a', NULL) AS z, named_struct('c', CAST(NULL AS STRING)) AS e, CAST(NULL AS STRUCT<q: INT>) AS n, array(named_struct('t', 1, 's', 2), NULL) AS l")
    assert df.select(E.canonical_json(df)).first()[0] == '{"e":{},"l":[{"s":2,"t":1},null],"z":{"a":null,"b":{"x":1,"y":[{"a":null,"k":2}]}}}'


def test_streams_leave_other_settings_alone(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    with retries.rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key, None) == before
