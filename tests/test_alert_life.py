"""Alert state over several runs of a stream: restart, late events, alerts that cease to be live, merged batches."""

import datetime

from stockloom.schemas import ALERT_EVENTS
from stockloom.sources import files
from stockloom.streaming import alerts

START = datetime.datetime(2024, 1, 1)


def event(alert, kind, day):
    return (alert, 1, "p1", "S", "P", "REORDER", "HIGH", "m", f"d{day}", kind, START + datetime.timedelta(days=day))


def at(day):
    return START + datetime.timedelta(days=day)


def run(spark, folder, rows, **how):
    """One more file of events, read by a stream that starts anew from its checkpoint."""
    spark.createDataFrame(rows, ALERT_EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    alerts.start_alert_state(alerts.read_events(spark, f"{folder}/events"), f"{folder}/out", **how).awaitTermination()
    return {r["alert_id"]: (r["resolved"], r["details"], r["resolved_at"]) for r in files.read_alert_state(spark, f"{folder}/out/state").collect()}


def test_late_and_repeated_events(spark, tmp_path):
    folder, how = str(tmp_path), {"compact_every": 2}
    got = run(spark, folder, [event("a", "raise", 5), event("b", "raise", 5), event("b", "resolve", 7), event("c", "resolve", 9)], **how)
    assert got == {"a": (False, "d5", None), "b": (True, "d5", at(7)), "c": (True, None, at(9))}
    # an older raise changes nothing, a raise before its resolving event is closed, a resolving event of equal time closes
    got = run(spark, folder, [event("a", "raise", 3), event("c", "raise", 8), event("b", "raise", 7)], **how)
    assert got == {"a": (False, "d5", None), "b": (True, "d7", at(7)), "c": (True, "d8", at(9))}
    assert files._merged(spark, f"{folder}/out/state") == [1]
    got = run(spark, folder, [event("a", "resolve", 6), event("b", "raise", 30)], **how)
    assert got == {"a": (True, "d5", at(6)), "b": (False, "d30", None), "c": (True, "d8", at(9))}


def test_resolved_alerts_cease_to_be_live(spark, tmp_path):
    folder, how = str(tmp_path), {"compact_every": 1, "keep_days": 10}
    run(spark, folder, [event("a", "raise", 1), event("a", "resolve", 2), event("b", "raise", 1), event("c", "raise", 1), event("c", "resolve", 95)], **how)
    run(spark, folder, [event("x", "raise", 100)], **how)
    state = f"{folder}/out/state"
    assert {r["alert_id"] for r in files.live_alerts(spark, state, 2).collect()} == {"b", "c", "x"}
    live = spark.read.parquet(f"{state}-merged/upto=1/live=true").inputFiles()
    assert all(f in live or "upto=1" not in f for f in files.live_alerts(spark, state, 2).inputFiles())
    # a late resolving event of an alert that isn't live doesn't touch what was written; a new raise opens it again
    assert run(spark, folder, [event("a", "resolve", 101)], **how)["a"] == (True, "d1", at(2))
    got = run(spark, folder, [event("a", "raise", 120)], **how)
    assert got["a"][:2] == (False, "d120") and got["b"] == (False, "d1", None) and got["c"] == (True, "d1", at(95)) and len(got) == 4


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    folder = str(tmp_path)
    first = run(spark, folder, [event("a", "raise", 1), event("b", "raise", 1)], compact_every=1)
    run(spark, folder, [event("a", "resolve", 2)], compact_every=1)
    # what a job that died behind its merge does again
    files.merge_alert_batches(spark, f"{folder}/out/state", 1, 30.0)
    got = {r["alert_id"]: r["resolved"] for r in files.read_alert_state(spark, f"{folder}/out/state").collect()}
    assert got == {"a": True, "b": False} and len(first) == 2
