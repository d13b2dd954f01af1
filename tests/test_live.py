"""Ended sessions from keyed state against a batch over the distinct lines."""

import json
import random
from datetime import datetime, timedelta

import pytest

from eventscope.operators import sessions
from eventscope.streaming import live, sessions as streaming
from tests.fixtures import c, log_event as log_event_at_zero

SCHEMA = "session string, pos long, eventid string, timestamp string, src_ip string, protocol string, src_port string, dst_ip string, dst_port string, duration string"


def log_event(session, eventid, second, **fields):
    at = datetime(2026, 4, 6, 12) + timedelta(seconds=second)
    return {**log_event_at_zero(session, eventid, 0, **fields), "timestamp": at.isoformat(timespec="microseconds") + "Z"}


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, live.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Log:
    """A folder that lines are added to, and the stream over it."""

    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.source, self.parts, self.checkpoint = (tmp_path / n for n in ("source", "parts", "checkpoint"))
        self.source.mkdir()
        self.files = 0

    def add(self, lines):
        self.files += 1
        text = "\n".join(json.dumps({**e, "pos": pos}) for pos, e in lines)
        (self.source / f"{self.files:03}.json").write_text(text)
        log = streaming.read_log_stream(self.spark, str(self.source), SCHEMA)
        live.write_finished_parts(log, str(self.parts), str(self.checkpoint), late="10 seconds", idle_seconds=30).trigger(
            availableNow=True
        ).start().awaitTermination()

    def ended(self):
        return {r.session for r in self.spark.read.parquet(str(self.parts)).select("session").distinct().collect()}

    def open(self):
        return {r.key.session for r in live.open_parts(self.spark, str(self.checkpoint)).collect()}

    def check(self):
        everything = self.spark.read.schema(SCHEMA).json(str(self.source)).dropDuplicates()
        log = sessions.clean_log(everything)
        folder = str(self.parts)
        for got, expected in (
            (streaming.sessions_so_far(self.spark, folder), sessions.build_sessions(log, event_ids=True)),
            (streaming.groups_so_far(self.spark, folder), sessions.session_groups(log)),
            (streaming.events_so_far(self.spark, folder), sessions.log_to_events(everything)),
        ):
            assert got.columns == expected.columns
            assert sorted(got.collect(), key=repr) == sorted(expected.collect(), key=repr)


def beat(second):
    """A line that is no event, but has a time."""
    return (-1, {**log_event("", "", second), "eventid": ""})


def test_late_repeated_and_unordered_lines(spark, tmp_path, rocks):
    log = Log(spark, tmp_path)
    closed = c("session.closed")
    log.add([
        (3, log_event("a", c("command.input"), 4)), (1, log_event("a", c("session.connect"), 1, src_port="1")),
        (1, log_event("a", c("session.connect"), 1, src_port="1")), (4, log_event("b", c("login.failed"), 2)),
    ])
    assert log.open() == {"a", "b"}
    # Repeats in a later batch, and a line from before all others.
    log.add([
        (1, log_event("a", c("session.connect"), 1, src_port="1")), (5, log_event("a", closed, 9, duration="8.5")),
        (0, log_event("a", c("login.success"), 0.25)), (4, log_event("b", c("login.failed"), 2)), beat(15),
    ])
    # The watermark is at 5: a's close is not passed yet.
    assert log.open() == {"a", "b"}
    log.add([(6, log_event("c", c("session.connect"), 18)), beat(25)])
    assert log.ended() == {"a"} and log.open() == {"b", "c"}
    # Late for a session that has ended, but not for the watermark.
    log.add([(7, log_event("a", c("command.input"), 16)), (7, log_event("a", c("command.input"), 16)), beat(60)])
    assert log.ended() == {"a", "b", "c"} and log.open() == set()
    assert log.ended() == {"a", "b", "c"} and log.open() == set()
    log.check()


def test_random_logs(spark, tmp_path, rocks):
    draw = random.Random(5)
    kinds = [c("session.connect"), c("login.failed"), c("login.success"), c("command.input"), c("session.closed")]
    lines = [
        (n, log_event(f"s{draw.randint(0, 11)}", draw.choice(kinds), round(n / 3, 2), src_port=str(n), duration=str(n)))
        for n in range(90)
    ]
    # Each line comes up to 8 seconds late, one in four twice.
    sent = sorted(
        [(n / 3 + draw.uniform(0, 8), (n, e)) for n, e in lines]
        + [(n / 3 + draw.uniform(0, 8), (n, e)) for n, e in lines if draw.random() < 0.25],
        key=lambda x: x[0],
    )
    log = Log(spark, tmp_path)
    for start in range(0, len(sent), 60):
        log.add([line for _, line in sent[start : start + 60]])
    log.add([beat(500)])
    assert log.open() == set()
    log.check()
