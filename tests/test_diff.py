import random
from collections import Counter, defaultdict

import pytest

from rowlens import api
from rowlens.errors import DiffError
from rowlens.operators import classified, multiset
from rowlens.plans.options import Options


def run(spark, left, right, schema, right_schema=None, **kw):
    return api.diff(spark, spark.createDataFrame(left, schema), spark.createDataFrame(right, right_schema or schema), Options(**kw))


def four(r):
    return r.added, r.removed, r.changed, r.unchanged


def test_keyed_counts_stats_and_examples(spark):
    r = run(spark, [(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (4, "d", 4.0)], [(1, "a", 1.0), (2, "B", 2.5), (3, "c", 3.0), (5, "e", 5.0)], "id long, s string, f double", key=["id"])
    assert four(r) == (1, 1, 2, 1) and (r.left_rows, r.right_rows) == (4, 4)
    assert r.column_changes == {"f": 2, "s": 1} and r.column_stats["f"]["max_abs_diff"] == 0.5
    assert r.column_stats["s"]["match_rate"] == pytest.approx(2 / 3)
    assert r.added_examples == ["5"] and r.removed_examples == ["4"]
    assert r.changed_examples[0] == {"key": "2", "columns": [{"column": "s", "left": "b", "right": "B"}, {"column": "f", "left": "2", "right": "2.5"}]}
    assert r.exit_code() == 1 and r.exit_code("4") == 0 and r.exit_code("3") == 1


def test_null_keys_zero_and_nan(spark):
    r = run(spark, [(None, -0.0), (1, float("nan"))], [(None, 0.0), (1, float("nan"))], "id long, f double", key=["id"])
    assert r.same and r.exit_code() == 0


def test_coercion_and_incomparable(spark):
    r = run(spark, [(1, 10, "x")], [(1.0, 10.0, 5)], "id long, v long, w string", "id double, v double, w long", key=["id"])
    assert four(r) == (0, 0, 0, 1) and [c["column"] for c in r.schema.type_changes] == ["id", "v", "w"] and not r.same
    with pytest.raises(DiffError, match="can't be compared"):
        run(spark, [("1",)], [(1,)], "id string", "id long", key=["id"])


def test_normalisation(spark):
    left, right = [(1, "Alice"), (2, "bob"), (3, "Carl"), (4, "dave")], [(1, "alice"), (2, "\u00a0 bob\t"), (3, "  CARL"), (4, "erin")]
    got = [run(spark, left, right, "id long, s string", key=["id"], trim=t, ignore_case=c).changed for t, c in ((False, False), (False, True), (True, False), (True, True))]
    assert got == [4, 3, 3, 1]


def test_float_precision(spark):
    left, right = [(1, 1.0001), (2, 2.5), (3, 1e308)], [(1, 1.0002), (2, 2.5000001), (3, 1e308)]
    assert [run(spark, left, right, "id long, f double", key=["id"], float_precision=n).changed for n in (0, 3, 4)] == [2, 0, 1]


def test_timestamps_floor_before_the_epoch(spark):
    sql = "select 1 id, timestamp'1969-12-31 23:59:59.{}' t"
    a, b, c = (spark.sql(sql.format(x)) for x in ("1", "9", "95"))
    assert api.diff(spark, a, b, Options(key=["id"], timestamp_precision="s")).same
    assert api.diff(spark, b, c, Options(key=["id"], timestamp_precision="ms")).changed == 1


def test_tolerance_reclassifies(spark):
    left = [(1, 1.0, 5), (2, 2.0, 5), (3, None, 5), (4, 100.0, 5)]
    right = [(1, 1.005, 5), (2, 2.5, 5), (3, 3.0, 5), (4, 100.5, 6)]
    r = run(spark, left, right, "id long, f double, n long", key=["id"], tolerance="f=0.01,rel=0.006")
    assert (r.within_tolerance, r.changed) == (1, 3) and r.column_changes == {"f": 2, "n": 1}
    for bad in ("x=1", "id=1"):
        with pytest.raises(DiffError):
            run(spark, left, right, "id long, f double, n long", key=["id"], tolerance=bad)


def test_duplicates_are_refused_on_either_side(spark):
    for a, b, side in (([(1, 1), (1, 2)], [(1, 1)], "left"), ([(1, 1)], [(1, 1), (1, 2)], "right")):
        with pytest.raises(DiffError, match=side):
            run(spark, a, b, "id long, v long", key=["id"])


def test_on_dup_warn(spark):
    r = run(spark, [(1, 10), (2, 20), (2, 21), (3, 30)], [(1, 10), (2, 20), (3, 31), (3, 32), (4, 40)], "id long, v long", key=["id"], on_dup="warn", order_by=["v"])
    assert four(r)[:3] == (1, 0, 1) and (r.dups_left, r.dups_right) == (1, 1)


def naive_match(left, right):
    keys, out = defaultdict(lambda: (Counter(), Counter())), Counter()
    for side, rows in enumerate((left, right)):
        for k, v in rows:
            keys[k][side][v] += 1
    for a, b in keys.values():
        out["unchanged"] += sum((a & b).values())
        x, y = sum((a - b).values()), sum((b - a).values())
        if x == y == 1:
            out["changed"] += 1
        else:
            out["removed"] += x
            out["added"] += y
    return tuple(out[n] for n in ("added", "removed", "changed", "unchanged"))


@pytest.mark.parametrize("seed", range(6))
def test_on_dup_match_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    side = lambda: [(rng.choice([None, *"abcdefg"]), rng.randrange(4)) for _ in range(16)]
    left, right = side(), side()
    a, b, plan = api.prepare(spark.createDataFrame(left, "k string, v long"), spark.createDataFrame(right, "k string, v long"), Options(key=["k"], on_dup="match"))
    want = naive_match(left, right)
    c = multiset.counts(a, b, plan).first()
    assert tuple(c[n] for n in ("added", "removed", "changed", "unchanged")) == want
    rows = classified.counts(multiset.classify(a, b, plan)).first()
    assert tuple(rows[n] for n in ("added", "removed", "changed", "unchanged")) == want
    assert c["unchanged"] + c["changed"] + c["removed"] == len(left) and c["unchanged"] + c["changed"] + c["added"] == len(right)


@pytest.mark.parametrize("seed", range(4))
def test_keyless_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    side = lambda: [(rng.choice([None, "a", "b"]), rng.randrange(3)) for _ in range(20)]
    left, right = side(), side()
    r = run(spark, left, right, "k string, v long", keyless=True)
    a, b = Counter(left), Counter(right)
    assert four(r) == (sum((b - a).values()), sum((a - b).values()), 0, sum((a & b).values()))


def test_swap_and_self(spark):
    rng = random.Random(5)
    left, right = ([(i, rng.randrange(3)) for i in range(40) if rng.random() < 0.8] for _ in range(2))
    a, b = run(spark, left, right, "id long, v long", key=["id"]), run(spark, right, left, "id long, v long", key=["id"])
    assert (a.added, a.removed, a.changed) == (b.removed, b.added, b.changed)
    assert run(spark, left, left[::-1], "id long, v long").same  # the key is inferred


def test_inference_prefers_ids_and_gives_up(spark):
    r = run(spark, [("a", 1, 7), ("b", 2, 8)], [("a", 1, 7), ("b", 2, 9)], "s string, v long, id long")
    assert r.key == ["id"]
    with pytest.raises(DiffError, match="no key"):
        run(spark, [(1,), (1,)], [(1,), (1,)], "v long")


def test_summary_equals_full(spark):
    left, right = [(i, i % 7, str(i)) for i in range(50)], [(i, i % 5, str(i)) for i in range(5, 60)]
    full, short = (run(spark, left, right, "id long, a long, s string", key=["id"], summary=x) for x in (False, True))
    assert four(full) == four(short)


def test_mask_rename_ignore_and_odd_names(spark):
    left = spark.createDataFrame([(1, "x", 2, 1)], ["id", "a.b `c`", "n__left", "z"])
    right = spark.createDataFrame([(1, "y", 3, 2)], ["id", "other", "n__left", "z"])
    r = api.diff(spark, left, right, Options(key=["id"], rename={"other": "a.b `c`"}, ignore_columns=["z"], mask=["a.b `c`", "id"]))
    assert r.changed == 1 and r.column_changes == {"a.b `c`": 1, "n__left": 1}
    e = r.changed_examples[0]
    assert e["key"].startswith("xxh:") and e["columns"][0]["left"].startswith("xxh:") and e["columns"][1] == {"column": "n__left", "left": "2", "right": "3"}
    with pytest.raises(DiffError, match="mask"):
        api.diff(spark, left, left, Options(key=["id"], mask=["q"]))


def test_where(spark):
    left, right = [(1, 5.0, "a"), (2, float("nan"), "b"), (3, None, None)], [(1, 6.0, "a"), (2, float("nan"), "b"), (4, 9.0, "c")]
    n = lambda w: (lambda r: (r.left_rows, r.right_rows))(run(spark, left, right, "id long, f double, s string", key=["id"], where=[w]))
    assert [n(w) for w in ("f > 1", "f != 5", "s is null", "s is not null and f <= 6", "id < 2.5", "s >= b")] == [(1, 2), (1, 3), (1, 0), (1, 1), (2, 2), (1, 2)]
    for bad in ("q = 1", "f = x", "id = 99999999999999999999"):
        with pytest.raises(DiffError):
            run(spark, left, right, "id long, f double, s string", key=["id"], where=[bad])


def test_budget_stops_early_and_json_is_stable(spark):
    r = run(spark, [(1, 1), (2, 2)], [(1, 9), (3, 3)], "id long, v long", key=["id"], max_diff="1")
    assert r.aborted and r.column_stats == {} and r.exit_code("1") == 1
    d = run(spark, [(1, 1)], [(1, 1)], "id long, v long", key=["id"]).as_dict()
    assert d["equal"] and list(d)[:3] == ["equal", "schema", "left_rows"] and d["schema"]["added_columns"] == []


def test_early_abort(spark):
    left = spark.range(20_000).selectExpr("id", "id % 7 v", "id * 0.5D f")
    right = spark.range(20_000).where("id % 20 <> 3").selectExpr("id", "if(id % 5 = 1, 9, id % 7) v", "id * 0.5D + 0.001D f").union(spark.range(30_000, 31_000).selectExpr("id", "0", "0.0D"))
    options = lambda **kw: Options(key=["id"], ignore_columns=kw.pop("ignore", ["f"]), **kw)
    whole = api.diff(spark, left, right, options())
    total = whole.added + whole.removed + whole.changed
    for budget in ("10", "0.1%"):
        r = api.diff(spark, left, right, options(max_diff=budget))
        assert r.aborted and r.partial_counts and not r.same and not r.rows_same and "budget of" in r.abort_reason
        assert r.added <= whole.added and r.removed <= whole.removed and r.changed <= whole.changed and 10 < r.added + r.removed + r.changed < total
        assert not r.column_stats and not r.changed_examples and r.as_dict()["partial_counts"] and r.exit_code(budget) == 1
    for budget in (str(total), "100%"):
        r = api.diff(spark, left, right, options(max_diff=budget))
        assert not r.aborted and four(r) == four(whole) and r.exit_code(budget) == 0
    r = api.diff(spark, left, right, options(max_diff=str(total - 1)))
    assert r.aborted and not r.partial_counts and four(r) == four(whole)  # beyond the slice the counts are whole
    r = api.diff(spark, left, right, options(max_diff="10", mode="stream"))
    assert r.aborted and not r.partial_counts and four(r) == four(whole)
    r = api.diff(spark, left, left.withColumn("f", left.f + 0.001), options(max_diff="10", ignore=[], tolerance="f=0.01"))
    assert not r.aborted and r.within_tolerance == 20_000  # judged after tolerance


def test_jobs_of_a_comparison(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id % 7 v").write.parquet(f"{tmp_path}/a")
    spark.range(10, 5010).selectExpr("id", "id % 9 v").write.parquet(f"{tmp_path}/b")
    sc = spark.sparkContext
    sc.setJobGroup("one comparison", "")
    r = api.diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", Options(key=["id"], output=f"{tmp_path}/o.parquet"))
    jobs = len(sc.statusTracker().getJobIdsForGroup("one comparison"))
    sc.setJobGroup("", "")
    assert (r.added, r.removed) == (10, 10) and spark.read.parquet(f"{tmp_path}/o.parquet").count() == r.added + r.removed + r.changed
    assert len(r.added_examples) == 10 == len(r.changed_examples) and jobs <= 14, jobs


def test_empty_sides(spark):
    assert four(run(spark, [], [(1, 1)], "id long, v long", key=["id"])) == (1, 0, 0, 0)
    assert run(spark, [], [], "id long, v long", key=["id"]).same
    assert four(run(spark, [], [], "id long, v long", keyless=True)) == (0, 0, 0, 0)
