import random
import time

import pytest

from shelfwise import schemas
from shelfwise.operators import commands as cmd
from shelfwise.operators import numbering
from shelfwise.streaming import read_raw_stream, run_intake


def simulate(log):
    """The same session, run one command at a time against a list."""
    out, shown, answers, items = [], [], [], []
    for session, seq, choice, title, host, duration in log:
        if choice not in (1, 2, 3, 4, 5):
            continue
        if choice == 1 and not (title and host and duration and 1 <= duration <= 1000):
            continue
        if choice == 3 and items and not title:
            continue
        if choice == 1:
            items.append((title, host, duration))
            out.append((seq, "added"))
        elif choice == 5:
            out.append((seq, "exiting"))
            break
        elif choice == 3:
            hit = next((i for i in items if i[0] == title), None)
            outcome = "empty" if not items else "found" if hit else "not_found"
            out.append((seq, outcome))
            answers.append((session, seq, title, outcome, *(hit[1:] if hit else (None, None))))
        elif not items:
            out.append((seq, "empty"))
        elif choice == 2:
            out.append((seq, "listed"))
            shown += [(session, seq, i + 1, *item) for i, item in enumerate(items)]
        else:
            out.append((seq, "sorted"))
            items.sort(key=lambda i: i[2])
    return out, shown, answers


def random_logs(rng, lengths):
    return {
        s: [(s, q, rng.choice([1, 1, 1, 2, 3, 3, 4, 9] + [5] * (q > length * 0.7)), rng.choice(["a", "b", "c", ""]), rng.choice(["h", "g", ""]), rng.choice([0, 5, 5, 7, 1000, 1001])) for q in range(length)]
        for s, length in enumerate(lengths)
    }


def check_replay(df, logs, max_lines=None):
    out, shown, answers = [], [], []
    for s, log in logs.items():
        a, b, c = simulate(log)
        out += [(s, *x) for x in a]
        shown += [x for x in b if max_lines is None or x[2] <= max_lines]
        answers += c
    assert sorted((r.session_id, r.seq, r.outcome) for r in cmd.outcomes(df).collect()) == sorted(out)
    assert sorted(map(tuple, cmd.replay_view(df, max_lines).collect())) == sorted(shown)
    assert sorted(map(tuple, cmd.replay_search(df).collect()), key=str) == sorted(answers, key=str)


def split_up(monkeypatch, rows, per_task, lines):
    monkeypatch.setattr(numbering, "ROWS_PER_BUCKET", rows)
    monkeypatch.setattr(cmd, "_ROWS_PER_TASK", per_task)
    monkeypatch.setattr(cmd, "_LINES_PER_BLOCK", lines)
    monkeypatch.setattr(cmd, "_SHORT_LIST", lines)


@pytest.mark.parametrize("seed,bucket,max_lines", [(0, None, None), (1, 7, 3), (2, 1, None)])
def test_replay_agrees_with_a_list(spark, monkeypatch, seed, bucket, max_lines):
    if bucket:  # hot sessions, cut into many buckets, give the same
        split_up(monkeypatch, bucket, 10, bucket)
    logs = random_logs(random.Random(seed), [40] * 12)
    check_replay(spark.createDataFrame([r for log in logs.values() for r in log], schemas.COMMAND), logs, max_lines)


def test_one_hot_session_among_many(spark, monkeypatch):
    """Only the hot one is split; the others stay one window each."""
    split_up(monkeypatch, 9, 60, 4)
    logs = random_logs(random.Random(5), [200, *[25] * 10])
    df = spark.createDataFrame([r for log in logs.values() for r in log], schemas.COMMAND)
    check_replay(df, logs)
    seen = []
    real = cmd._with_state
    monkeypatch.setattr(cmd, "_with_state", lambda log, split: seen.append((split, {r.session_id for r in log.select("session_id").distinct().collect()})) or real(log, split))
    cmd.effective(df)
    assert seen == [(False, set(range(1, 11))), (True, {0})]


@pytest.mark.parametrize("short", [0, 1, 5])
def test_short_and_long_lists(spark, monkeypatch, short):
    """Views of short lists and of longer ones in the same sessions."""
    monkeypatch.setattr(cmd, "_SHORT_LIST", short)
    logs = random_logs(random.Random(7), [40, 25, 3])
    df = spark.createDataFrame([r for log in logs.values() for r in log], schemas.COMMAND)
    shown = [x for log in logs.values() for x in simulate(log)[1]]
    assert sorted(map(tuple, cmd.replay_view(df).collect())) == sorted(shown)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_long_list_is_many_join_keys(spark, monkeypatch):
    split_up(monkeypatch, 50, 100, 20)
    log = [(1, q, 1, f"t{q}", "h", 1 + q * 7 % 50) for q in range(300)] + [(1, 300, 4, "", "", 0)]
    log += [(1, 301 + i, 2 if i % 2 else 1, "late", "h", 1) for i in range(20)]
    df = spark.createDataFrame(log, schemas.COMMAND)
    lines = cmd._lines(df, True, None)
    keys = lines.groupBy("session_id", "epoch", "asked_block").count().collect()
    assert len(keys) >= 15 and max(r["count"] for r in keys) <= 20 * 10
    assert sorted(map(tuple, cmd.replay_view(df).collect())) == sorted(simulate(log)[1])
    head = cmd._lines(df, True, 5)
    assert head.select("asked_block").distinct().collect() == [(0,)] and "(ordinal" in plan_of(head)


def test_outcomes_read_the_log_once(spark, tmp_path):
    """Beside the count of the sessions: one scan and one exchange."""
    rows = [r for log in random_logs(random.Random(1), [30] * 4).values() for r in log]
    spark.createDataFrame(rows, schemas.COMMAND).write.parquet(str(tmp_path / "log"))
    plan = plan_of(cmd.outcomes(spark.read.parquet(str(tmp_path / "log"))))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_view_head(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", "h", 30), (1, 2, 1, "b", "h", 10), (1, 3, 4, "", "", 0), (1, 4, 1, "c", "h", 5), (1, 5, 2, "", "", 0)], schemas.COMMAND)
    assert [r.title for r in cmd.replay_view(df).orderBy("ordinal").collect()] == ["b", "a", "c"]
    assert [r.title for r in cmd.replay_view(df, max_lines=1).collect()] == ["b"]


def test_typed_choices(spark):
    rows = [(1, 1, " 1x", "a", "h", 30), (1, 2, "view", "", "", 0), (1, 3, "2", "", "", 0), (1, 4, "99999999999", "", "", 0), (1, 5, "5", "", "", 0)]
    df = spark.createDataFrame(rows, "session_id long, seq long, choice string, title string, host string, duration int")
    assert [(r.seq, r.outcome) for r in cmd.outcomes(cmd.parse_choices(df)).orderBy("seq").collect()] == [(1, "added"), (3, "listed"), (5, "exiting")]


def test_stream_classifies_like_a_batch(spark, sf_dir, tmp_path):
    from shelfwise.operators.intake import classify
    from shelfwise.sources import raw_records

    raw = raw_records(spark, sf_dir)
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    query = run_intake(read_raw_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = sorted((r.seq, r.status) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "status").collect())
    assert got == sorted((r.seq, r.status) for r in classify(raw).select("seq", "status").collect())


@pytest.mark.parametrize("stops", [1, 3])
def test_stream_goes_on_after_a_stop(spark, sf_dir, tmp_path, stops):
    """Stopped after some batches and started again from its checkpoint, while files still come."""
    from shelfwise.operators.intake import classify
    from shelfwise.sources import raw_records

    raw = raw_records(spark, sf_dir)
    raw.where("seq % 3 > 0").repartition(6).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("out", "state")]
    source = lambda: read_raw_stream(spark, str(tmp_path / "in"), 1)
    for n in range(1, stops + 1):
        query = run_intake(source(), *paths)
        deadline = time.time() + 60
        while len(query.recentProgress) < 1 and query.isActive and time.time() < deadline:
            time.sleep(0.01)
        query.stop()
    raw.where("seq % 3 = 0").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    query = run_intake(source(), *paths)
    query.awaitTermination(120)
    assert query.exception() is None
    got = sorted((r.seq, r.status) for r in spark.read.parquet(paths[0]).select("seq", "status").collect())
    assert got == sorted((r.seq, r.status) for r in classify(raw).select("seq", "status").collect())
    run_intake(source(), *paths).awaitTermination(60)  # nothing new: nothing is added
    assert spark.read.parquet(paths[0]).count() == len(got)
