import random

import pytest
from pyspark.sql import functions as F

from hostpulse.functions import columns as C
from hostpulse.operators import profiles, rank


def samples(spark, rows):
    """rows: (comm, pid, tid, user names, kernel names, count)"""
    df = spark.createDataFrame([("h", i, i, *r) for i, r in enumerate(rows)],
                               "host STRING, seq BIGINT, timestamp_ns BIGINT, comm STRING, pid BIGINT, tid BIGINT, u ARRAY<STRING>, "
                               "k ARRAY<STRING>, count BIGINT")
    return df.select("host", "seq", "timestamp_ns", "comm", "pid", "tid", "count", F.lit(0).cast("bigint").alias("cpu"),
                     (F.col("count") * 1000).alias("duration_ns"), F.lit("oncpu").alias("sample_type"),
                     C.frames_from_names("u").alias("user_stack"), C.frames_from_names("k").alias("kernel_stack"))


def counts(df):
    return sorted(r["count"] for r in df.collect())


@pytest.mark.parametrize("by,rows,want", [
    ("comm", [("app", 100, 0, ["main"], [], 1), ("app", 100, 1, ["main"], [], 1)], [2]),
    ("comm", [("a", 1, 0, ["main"], [], 1), ("b", 1, 0, ["main"], [], 1)], [1, 1]),
    ("pid", [("p1", 42, 1, ["foo"], [], 2), ("p2", 42, 2, ["foo"], [], 3)], [5]),
    ("tid", [("x", 7, 99, ["bar"], [], 1), ("y", 7, 99, ["bar"], [], 1)], [2]),
    ("global", [("x", 1, 0, ["baz"], [], 1), ("y", 2, 0, ["baz"], [], 4)], [5]),
    ("global", [("x", 1, 0, ["leaf"], [], c) for c in (2, 3, 5)], [10]),
])
def test_merge(spark, by, rows, want):
    assert counts(profiles.merge_stacks(samples(spark, rows), by)) == want


def test_merge_kernel_option_and_first_sample(spark):
    s = samples(spark, [("x", 1, 5, ["u1"], ["k1"], 1), ("x", 1, 6, ["u1"], ["k2"], 2)])
    assert counts(profiles.merge_stacks(s, "comm")) == [1, 2]
    one = profiles.merge_stacks(s, "comm", include_kernel=False).collect()
    assert len(one) == 1 and one[0]["count"] == 3 and one[0]["tid"] == 5
    assert one[0]["duration_ns"] == 1000 and one[0]["duration_ns_sum"] == 3000
    assert one[0]["kernel_stack"][0]["function_name"] == "k1"


def test_merge_by_label_joins_named_frames_of_different_addresses(spark):
    s = samples(spark, [("x", 1, 5, ["f"], [], 1), ("x", 1, 6, ["f"], [], 2), ("x", 1, 7, [""], [], 4), ("x", 1, 7, [""], [], 8)])
    moved = s.withColumn("user_stack", F.transform("user_stack", lambda f: f.withField("address", F.col("seq").cast(C.ADDRESS))))
    assert counts(profiles.merge_stacks(moved, "comm")) == [3, 4, 8]


def test_folded(spark):
    s = samples(spark, [("worker", 1, 1, ["root_fn", "leaf_fn"], ["kern"], 4), ("c", 1, 1, ["g"], [], 5), ("c", 2, 2, ["g"], [], 9),
                        ("", 1, 1, [], [], 3), ("", 1, 1, ["f"], [], 1)])
    got = {r["stack"]: r["count"] for r in profiles.folded_stacks(s).collect()}
    assert got == {"worker;leaf_fn;root_fn": 4, "c;g": 14, ";f": 1}
    anon = samples(spark, [("anon", 1, 1, [""], [], 1)]).withColumn(
        "user_stack", F.transform("user_stack", lambda f: f.withField("address", F.lit(0xdeadbeef).cast(C.ADDRESS))))
    assert profiles.folded_stacks(anon).collect()[0]["stack"] == "anon;0xdeadbeef"


def tree_of(rows, offcpu=False):
    nodes = {}
    for comm, _, _, user, kernel, count in rows:
        comm = comm or "unknown"
        path = [comm] + [f"[{comm}]" if not n or n.startswith("[0x") else n for n in reversed(user)]
        path += [n or "[kernel]" for n in reversed(kernel)]
        if len(path) == 1:
            path.append("[no stack]")
        weight = max(1, int(count * 1000 / 1000 + 0.5)) if offcpu and count else (count or 1)
        for i in range(len(path) + 1):
            nodes[tuple(path[:i])] = nodes.get(tuple(path[:i]), 0) + weight
    return nodes


@pytest.mark.parametrize("offcpu", [False, True])
def test_flame_tree_equals_tree_builder(spark, offcpu):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", ""]), 1, 1, [rnd.choice(["f", "g", "", "[0x12]"]) for _ in range(rnd.randrange(5))],
             [rnd.choice(["k", ""]) for _ in range(rnd.randrange(3))], rnd.randrange(4)) for _ in range(400)]
    tree = profiles.flame_tree(samples(spark, rows), offcpu).collect()
    assert {tuple(r["path"]): r["value"] for r in tree} == tree_of(rows, offcpu)
    root = [r for r in tree if r["depth"] == 0]
    assert root[0]["name"] == "root" and root[0]["value"] == sum(r["self_value"] for r in tree)


def test_null_stacks(spark):
    s = samples(spark, [("a", 1, 1, ["f"], [], 1)]).withColumn("kernel_stack", F.lit(None).cast(
        "array<struct<address:decimal(20,0),function_name:string,file_name:string,line_number:bigint,module_name:string>>"))
    assert {tuple(r["path"]) for r in profiles.flame_tree(s).collect()} == {(), ("a",), ("a", "f")}


def test_diff(spark):
    base = profiles.flame_tree(samples(spark, [("a", 1, 1, ["old"], [], 10), ("a", 1, 1, ["same"], [], 10)]))
    comp = profiles.flame_tree(samples(spark, [("a", 1, 1, ["new"], [], 5), ("a", 1, 1, ["same"], [], 20)]))
    diff = profiles.profile_diff(base, comp)
    got = {r["name"]: (r["base_value"], r["comp_value"], r["change_pct"]) for r in diff.collect()}
    assert got == {"a": (20, 25, 25.0), "old": (10, 0, -100.0), "same": (10, 20, 100.0), "new": (0, 5, 100.0)}
    s = profiles.diff_summary(diff).collect()[0]
    assert (s["total"], s["increased"], s["decreased"], s["new"], s["removed"]) == (4, 3, 1, 1, 1)
    flame = {r["name"]: (r["delta"], r["change"]) for r in profiles.diff_flame(base, comp).collect()}
    assert flame == {"root": (0.0, "unchanged"), "a": (0.25, "regression"), "new": (1.0, "regression"), "same": (1.0, "regression")}
    assert [r["name"] for r in rank.rank_diff(diff, "diff").collect()] == ["new", "old", "same", "a"]
    assert [r["name"] for r in rank.rank_diff(diff, "name", "E").collect()] == ["new", "same"]


def test_window_profile(spark):
    s = samples(spark, [("a", 1, 2, ["f"], [], 3), ("b", 1, 2, ["f"], [], 5)])
    r = profiles.window_profile(s).collect()
    assert len(r) == 1 and r[0]["count"] == 8 and r[0]["comm"] == "b"


def test_greatest_comm_of_a_flush(spark):
    """The last sample isn't the one with the greatest name."""
    s = samples(spark, [("b", 1, 2, ["f"], [], 3), ("a", 1, 2, ["f"], [], 5)])
    assert [r["comm"] for r in profiles.window_profile(s).collect()] == ["a"]
    assert [r["comm"] for r in profiles.window_profile(s, comm_of="greatest").collect()] == ["b"]


@pytest.mark.parametrize("by", ["comm", "pid", "tid", "global"])
def test_merging_shuffles_once(spark, by):
    s = samples(spark, [("a", 1, 2, ["f"], [], 3), ("a", 1, 2, ["f"], [], 5)])
    plan = profiles.merge_stacks(s, by)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tree_hashes_stacks_after_they_are_summed(spark):
    """No filter on the hash of a path reaches the scan, where it would hash every sample."""
    s = samples(spark, [("a", 1, 2, ["f"], [], 3)])
    plan = profiles.flame_tree(s)._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "aggregate(" in x]


def test_attach_stacks(spark):
    frames = spark.createDataFrame([("h", 1, ["10", "20", "0", "30"]), ("h", 0, ["9"])], "host STRING, stack_id INT, a ARRAY<STRING>")
    frames = frames.select("host", "stack_id", F.transform("a", lambda x: x.cast(C.ADDRESS)).alias("addresses"))
    s = spark.createDataFrame([("h", 1, 0), ("h", 77, -1), ("h", 1, 1)], "host STRING, kernel_stack_id INT, user_stack_id INT")
    got = [([int(f["address"]) for f in r["kernel_stack"]], [int(f["address"]) for f in r["user_stack"]])
           for r in profiles.attach_stacks(s, frames).collect()]
    assert sorted(got) == [([], []), ([10, 20], []), ([10, 20], [10, 20])]
    short = profiles.attach_stacks(s, frames, depth=1).collect()
    assert max(len(r["kernel_stack"]) for r in short) == 1


def test_tree_does_not_expand_samples(spark):
    """The plan sums by raw stack before it builds paths and prefixes."""
    s = samples(spark, [("a", 1, 1, ["f"], [], 1)])
    plan = profiles.flame_tree(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Aggregate [comm")


def test_deep_stacks_are_shuffled_level_by_level(spark):
    """Stacks of 127 frames with shared beginnings, against prefixes made one by one; levels carry no path."""
    deep = [("a", 1, 1, [f"f{i if i < 100 + 9 * k else i * 1000 + k}" for i in range(126, -1, -1)], [], 2 + k) for k in range(4)]
    s = samples(spark, deep + [("a", 1, 1, [], [], 1)])
    want = {}
    for comm, _, _, user, _, n in [*deep, ("a", 1, 1, [], [], 1)]:
        path = (comm, *reversed(user)) if user else (comm, "[no stack]")
        for d in range(len(path) + 1):
            want[path[:d]] = want.get(path[:d], 0) + n
    assert {tuple(r["path"]): r["value"] for r in profiles.flame_tree(s).collect()} == want
    nodes, _ = profiles._tree_nodes(profiles.sample_paths(s), [])
    shuffled = nodes._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert shuffled.startswith("Aggregate") and "path" not in shuffled and "slice" not in shuffled
