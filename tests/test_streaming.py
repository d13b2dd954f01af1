import json

from eventscope.operators import sessions
from eventscope.streaming import sessions as streaming
from tests.fixtures import log_event, c

SCHEMA = "session string, pos long, eventid string, timestamp string, src_ip string, protocol string, src_port string, dst_ip string, dst_port string, duration string"


def write(folder, name, events):
    lines = [json.dumps({**e, "pos": pos}) for pos, e in events]
    (folder / name).write_text("\n".join(lines))


def test_stream_equals_batch(spark, tmp_path):
    source, parts, checkpoint = (tmp_path / n for n in ("source", "parts", "checkpoint"))
    source.mkdir()
    events = [
        log_event("a", c("session.connect"), 1, src_port="1"), log_event("b", c("login.failed"), 2),
        log_event("a", c("login.success"), 3), log_event("a", c("session.closed"), 9, duration="8.5"),
        log_event("b", c("command.input"), 4), log_event("a", c("command.input"), 0.5),
    ]
    numbered = list(enumerate(events))

    def run():
        log = streaming.read_log_stream(spark, str(source), SCHEMA)
        streaming.write_parts(log, str(parts), str(checkpoint)).trigger(availableNow=True).start().awaitTermination()

    write(source, "1.json", numbered[:3])
    run()
    write(source, "2.json", numbered[3:])
    run()
    everything = spark.read.schema(SCHEMA).json(str(source))
    log = sessions.clean_log(everything)
    compact = tmp_path / "compact"
    streaming.compact_parts(spark, str(parts), str(compact))

    def same(got, expected):
        assert got.columns == expected.columns
        assert sorted(got.collect(), key=repr) == sorted(expected.collect(), key=repr)

    for folder in (parts, compact):
        same(streaming.sessions_so_far(spark, str(folder)), sessions.build_sessions(log, event_ids=True))
        same(streaming.groups_so_far(spark, str(folder)), sessions.session_groups(log))
        same(streaming.events_so_far(spark, str(folder)), sessions.log_to_events(everything))
