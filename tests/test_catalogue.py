import pytest

from shelfwise import schemas
from shelfwise.operators import catalogue as cat
from shelfwise.operators import intake
from shelfwise.operators.numbering import by_duration, by_position, position_bucket

STATUS = {
    "12": ("ok", 12), "  12": ("ok", 12), "\t\x0b\f\r12": ("ok", 12), "12abc": ("ok", 12), "12 99": ("ok", 12),
    "3.7": ("ok", 3), "1e3": ("ok", 1), "1,000": ("ok", 1), "+5": ("ok", 5), "007": ("ok", 7), "000000000000005": ("ok", 5),
    "1": ("ok", 1), "1000": ("ok", 1000), "0": ("duration_out_of_range", 0), "-0": ("duration_out_of_range", 0),
    "0x1F": ("duration_out_of_range", 0), "1001": ("duration_out_of_range", 1001), "-5": ("duration_out_of_range", -5),
    "2147483647": ("duration_out_of_range", 2147483647), "2147483648": ("duration_not_integer", None),
    "99999999999999999999": ("duration_not_integer", None), "abc": ("duration_not_integer", None), "-": ("duration_not_integer", None),
    "+-5": ("duration_not_integer", None), "- 5": ("duration_not_integer", None), " 5": ("duration_not_integer", None),
    "٥": ("duration_not_integer", None), "": ("duration_missing", None), "   ": ("duration_missing", None), None: ("duration_missing", None),
}


def test_duration_cases(spark):
    cases = list(STATUS)
    raw = spark.createDataFrame([(i, "t", " ", c) for i, c in enumerate(cases)], schemas.RAW)
    got = {r.seq: (r.status, r.duration) for r in intake.classify(raw).collect()}
    assert got == {i: STATUS[c] for i, c in enumerate(cases)}


def test_first_failing_field_wins(spark):
    raw = spark.createDataFrame([(1, "", "", "x"), (2, "t", None, "x"), (3, None, "h", "5"), (4, " ", " ", "5")], schemas.RAW)
    got = {r.seq: r.status for r in intake.classify(raw).collect()}
    assert got == {1: "title_empty", 2: "host_empty", 3: "title_empty", 4: "ok"}


def test_retries_skip_blank_and_bad_attempts(spark):
    rows = [(1, 1, "abc"), (1, 2, " "), (1, 3, "0"), (1, 4, "7x"), (1, 5, "8"), (2, 1, None), (2, 2, "1001")]
    got = intake.collapse_retries(spark.createDataFrame(rows, schemas.ATTEMPT)).collect()
    assert [tuple(r) for r in got] == [(1, 7)]


def _catalogue(spark, rows):
    return spark.createDataFrame(rows, schemas.CATALOGUE)


def test_append_keeps_duplicates_and_order(spark):
    base = _catalogue(spark, [(0, "a", "h", 3), (7, "b", "h", 1)])
    batch = spark.createDataFrame([(90, "a", "h", 3), (5, "c", "h", 2)], "seq long, title string, host string, duration int")
    got = sorted(tuple(r)[:2] for r in intake.append(base, batch).collect())
    assert got == [(0, "a"), (7, "b"), (8, "c"), (9, "a")]
    into_empty = sorted(tuple(r)[:2] for r in intake.append(base.limit(0), batch).collect())
    assert into_empty == [(0, "c"), (1, "a")]


def test_search_takes_the_first_in_current_order(spark):
    items = _catalogue(spark, [(1, "X", "host1", 9), (2, "X", "host2", 3), (3, "Y", "h", 3)])
    assert cat.find_title(items, "X").first().host == "host1"
    assert cat.find_title(cat.resequence_by_duration(items), "X").first().host == "host2"
    assert cat.find_title(items, "x").count() == 0


def test_batch_search_outcomes(spark):
    items = _catalogue(spark, [(1, "X", "host1", 9), (2, "X", "host2", 3)])
    probes = spark.createDataFrame([(1, "X"), (2, "x"), (3, ""), (4, None)], schemas.PROBE)
    assert {r.probe_id: r.outcome for r in cat.find_titles(items, probes).collect()} == {1: "found", 2: "not_found"}
    assert [r.outcome for r in cat.find_titles(items.limit(0), probes).collect()] == ["empty"] * 4


def _positions(kind):
    if kind == "even":
        return [i * 700_001 for i in range(400)]
    if kind == "sparse":  # as hashes are
        return [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(400)]
    return [*range(350), *(10**18 + i * 10**15 for i in range(50))]  # crowded, with outliers


@pytest.mark.parametrize("kind", ["even", "sparse", "crowded"])
@pytest.mark.parametrize("by_dur", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [10, 1000])
def test_ordinals(spark, monkeypatch, kind, by_dur, rows_per_bucket):
    from shelfwise.operators import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_BUCKET", rows_per_bucket)
    rows = [(p, "t", "h", (i * 7919) % 3) for i, p in enumerate(_positions(kind))]
    items = _catalogue(spark, rows)
    got = {r.pos: r.n for r in (by_duration(items, "n") if by_dur else by_position(items, "pos", "n")).collect()}
    order = sorted(rows, key=lambda r: (r[3], r[0])) if by_dur else sorted(rows)
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}
    bucket = position_bucket(items, "pos")
    if rows_per_bucket > len(rows):
        assert bucket is None
    else:  # the counts that meet in one task follow the rows, not the spread of the positions
        assert 20 <= items.select(bucket).distinct().count() <= 2 * numbering.RANGES


def test_ordinals_of_many_rows_do_not_meet_in_one_task(spark, sf_dir, monkeypatch):
    from shelfwise.operators import numbering
    from shelfwise.sources import catalogue

    monkeypatch.setattr(numbering, "ROWS_PER_BUCKET", 100)
    items = catalogue(spark, sf_dir)
    moved = cat.resequence_by_duration(items)
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1  # one row for each stretch of durations
    assert moved.orderBy("pos").collect() == [(i, *r[1:]) for i, r in enumerate(items.orderBy("duration", "pos").collect(), 1)]


@pytest.mark.parametrize("keys", [1, 3])
def test_offsets_meet_level_by_level(spark, keys):
    """Whatever the number of buckets, the single task gets one row for each value of the first key."""
    from shelfwise.operators import numbering

    rows = [(a, b, c, 1 + (a + b + c) % 3) for a in (-2, 0, 5) for b in range(4) for c in range(7)]
    counts = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, __n long")
    names = [f"k{i}" for i in range(keys)]
    from pyspark.sql import functions as F

    counts = counts.groupBy(*names).agg(F.sum("__n").alias("__n"))
    got = {tuple(r[:-1]): r[-1] for r in numbering._offsets(counts, [], names).collect()}
    want, total = {}, 0
    for r in sorted(counts.collect()):
        want[tuple(r[:-1])], total = total, total + r[-1]
    assert got == want
    plan = numbering._offsets(counts, [], names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1


def test_ordinals_of_any_durations(spark, monkeypatch):
    from shelfwise.operators import numbering

    monkeypatch.setattr(numbering, "ROWS_PER_BUCKET", 5)
    odd = [None, -(2**31), 2**31 - 1, 0, 5000, 4095, 4096, -1]
    rows = [(p if p else None, "t", "h", odd[p * 5 % 8]) for p in range(40)]
    got = {(r.pos, r.duration): r.n for r in by_duration(_catalogue(spark, rows), "n").collect()}
    low = -(2**31) - 1
    order = sorted(rows, key=lambda r: (low if r[3] is None else r[3], -1 if r[0] is None else r[0]))
    assert got == {(r[0], r[3]): i for i, r in enumerate(order, 1)}


@pytest.mark.parametrize("duration", [3, None])
def test_search_after_a_sort_counts_and_does_not_number(spark, tmp_path, duration):
    rows = [(p, f"t{p % 9}", "h", None if p % 11 == 0 else p * 7 % 5) for p in range(60)] + [(60, "only", "h", duration), (61, None, "h", 2), (None, "t3", "g", 0)]
    _catalogue(spark, rows).write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    for term in ("t3", "t0", "only", "nowhere", "T3"):
        want = cat.find_title(cat.resequence_by_duration(items), term)
        got = cat.find_title_after_sort(items, term)
        assert got.collect() == want.collect() and got.dtypes == want.dtypes
    plan = cat.find_title_after_sort(items, "only")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "duration" in plan.split("PushedFilters")[1] and "title" not in plan.split("ReadSchema")[1]


def test_batch_search_leaves_out_what_no_probe_asks_for(spark, monkeypatch):
    items = _catalogue(spark, [(p, f"t{p % 500}", "h", 1) for p in range(3000)] + [(-1, None, "h", 1)])
    probes = spark.createDataFrame([(i, f"t{i}") for i in range(5)] + [(9, "none"), (10, "t3")], schemas.PROBE)
    assert cat._asked_for(items, probes).count() <= 40  # 30 asked for, and a chance meeting at most
    got = {r.probe_id: (r.outcome, r.pos) for r in cat.find_titles(items, probes).collect()}
    assert got == {**{i: ("found", i) for i in range(5)}, 9: ("not_found", None), 10: ("found", 3)}
    monkeypatch.setattr(cat, "TITLE_HASHES", 1)  # a filter that lets all through changes nothing
    assert {r.probe_id: (r.outcome, r.pos) for r in cat.find_titles(items, probes).collect()} == got


def test_defaults_and_corrections(spark):
    items = _catalogue(spark, [(1, "a", "h", 3), (2, None, None, None)])
    fixes = spark.createDataFrame([(1, 1, "", None, 5000), (9, 2, "z", "z", 1)], schemas.CORRECTION)
    got = sorted(map(tuple, cat.fill_defaults(cat.correct(items, fixes)).collect()))
    assert got == [(1, "", "h", 5000), (2, "", "", 0)]


def test_the_last_correction_of_each_field_stands(spark):
    items = _catalogue(spark, [(1, "a", "h", 3), (2, "b", "h", 3), (2, "c", "h", 4), (3, "d", "h", 5)])
    feed = [(1, 5, "late", None, None), (1, 2, "early", "new host", None), (1, 9, None, None, None), (2, 1, None, None, 0), (2, 4, None, None, -7),
            (None, 1, "x", "x", 1), (8, 1, "x", "x", 1), (3, 6, "m", None, None), (3, 6, "k", "tie", None), (3, None, "oldest", "oldest", 9)]
    got = cat.correct(items, spark.createDataFrame(feed, schemas.CORRECTION))
    assert sorted(map(tuple, got.collect())) == [(1, "late", "new host", 3), (2, "b", "h", -7), (2, "c", "h", -7), (3, "m", "tie", 9)]
    assert cat.correct(items, spark.createDataFrame([], schemas.CORRECTION)).count() == 4


def test_random_corrections_against_setters(spark):
    import random

    rng = random.Random(4)
    records = {p: ["t", "h", 1] for p in range(20)}
    feed = [(rng.randrange(25), q, *(rng.choice([None, None, x]) for x in (f"t{q}", f"h{q}", q))) for q in range(300)]
    for pos, _, *fields in feed:
        for i, value in enumerate(fields):
            if pos in records and value is not None:
                records[pos][i] = value
    rng.shuffle(feed)
    items = _catalogue(spark, [(p, "t", "h", 1) for p in range(20)])
    got = cat.correct(items, spark.createDataFrame(feed, schemas.CORRECTION))
    assert {r.pos: [*r[1:]] for r in got.collect()} == records
