"""Call-stack samples: counting, merging, flame trees, function totals, diffs, folded stacks.

Stack arrays are leaf first.  Samples are first summed by their raw stacks, so names and paths are
built once per distinct stack, and trees are summed by full path before prefixes are expanded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import top_per_key

ROOT = "root"


def _addresses(stack: str):
    return F.transform(stack, lambda f: f["address"])


def profile_counts(cpu_samples: DataFrame, window="1 second") -> DataFrame:
    """Samples per process, thread, stack pair and comm per interval."""
    start = C.floor_to("timestamp_ns", C.duration_ns(window))
    return (cpu_samples.groupBy("host", start.alias("window_ns"), "pid", "tid", "kernel_stack_id",
                                "user_stack_id", "comm").agg(F.count(F.lit(1)).alias("count")))


def attach_stacks(samples: DataFrame, stack_frames: DataFrame, depth: int | None = None) -> DataFrame:
    """Replace stack ids by frames; id <= 0 or unknown gives an empty stack, a 0 address ends it.

    ``depth`` keeps so many frames at most; all are kept without it.
    """
    cut = F.col("addresses") if depth is None else F.slice("addresses", 1, depth)
    zero = F.array_position(cut, F.lit(0).cast(C.ADDRESS))
    known = stack_frames.where(F.col("stack_id") > 0).select(
        "host", F.col("stack_id").alias("__id"),
        F.when(zero > 0, F.slice(cut, F.lit(1), (zero - 1).cast("int"))).otherwise(cut).alias("__addresses"))
    out = samples
    for kind in ("kernel", "user"):
        side = known.select(F.col("host").alias("__host"), F.col("__id"), "__addresses")
        found = C.frames_from_addresses(F.coalesce("__addresses", F.array().cast(f"array<{C.ADDRESS}>")))
        out = (out.join(side, (F.col("host") == F.col("__host")) & (F.col(f"{kind}_stack_id") == F.col("__id")), "left")
               .withColumn(f"{kind}_stack", found).drop("__host", "__id", "__addresses"))
    return out


def window_profile(samples: DataFrame, window="10 seconds", comm_of: str = "last") -> DataFrame:
    """Sum of counts per process, thread and address stacks; comm of the last sample, or the ``greatest`` one."""
    if comm_of not in ("last", "greatest"):
        raise ValueError(f"comm_of is last or greatest, not {comm_of}")
    start = C.floor_to("timestamp_ns", C.duration_ns(window))
    keyed = samples.withColumn("window_ns", start).withColumn("__u", _addresses("user_stack")) \
        .withColumn("__k", _addresses("kernel_stack"))
    at = F.struct("timestamp_ns", "comm")
    return (keyed.groupBy("host", "window_ns", "pid", "tid", "__u", "__k")
            .agg((F.max_by("comm", at) if comm_of == "last" else F.max("comm")).alias("comm"), F.sum("count").alias("count"),
                 F.min_by(F.struct("user_stack", "kernel_stack"), at).alias("__s"))
            .select("host", "window_ns", "pid", "tid", "comm", "count", F.col("__s.user_stack").alias("user_stack"),
                    F.col("__s.kernel_stack").alias("kernel_stack")))


MERGE_KEYS = {"comm": ["comm"], "pid": ["pid"], "tid": ["pid", "tid"], "global": []}


def merge_stacks(samples: DataFrame, by: str = "comm", include_kernel: bool = True) -> DataFrame:
    """Sum counts of samples with the same group and the same function path.

    Other columns come from the first sample (by time, pid, tid); ``duration_ns_sum`` adds what a
    first-sample duration loses.
    """
    group = MERGE_KEYS.get(by, MERGE_KEYS["comm"])
    stacks = ["user_stack"] + (["kernel_stack"] if include_kernel else [])
    first = ["timestamp_ns", "pid", "tid"] + (["seq"] if "seq" in samples.columns else [])
    rest = [c for c in samples.columns if c not in (*group, *stacks, "count")]
    paths = [f"__p_{c}" for c in stacks]
    keyed = samples.select("*", *[_labels(c).alias(p) for c, p in zip(stacks, paths)])
    # rows are shuffled once, after they are summed in their tasks; the hash in front makes the sort of wide keys a sort of numbers
    merged = keyed.groupBy(F.xxhash64(*group, *paths).alias("__h"), *group, *paths).agg(
        F.sum("count").alias("count"), F.sum("duration_ns").alias("duration_ns_sum"),
        F.min_by(F.struct(F.struct(*rest).alias("__rest"), *stacks), F.struct(*first)).alias("__first"))
    return merged.select(*group, "count", "duration_ns_sum", "__first.__rest.*",
                         *[F.col(f"__first.{c}").alias(c) for c in stacks])


def _labels(stack: str):
    kind = "u" if stack == "user_stack" else "k"
    return F.transform(stack, lambda f: C.frame_label(f, kind))


# --- flame trees ------------------------------------------------------------------------------

def _path(comm, user_stack, kernel_stack):
    comm = F.coalesce(F.nullif(comm, F.lit("")), F.lit("unknown"))
    own = F.concat(F.lit("["), comm, F.lit("]"))

    def user(f):
        name = F.coalesce(f["function_name"], F.lit(""))
        return F.when((name == "") | name.startswith("[0x"), own).otherwise(name)

    frames = F.concat(
        F.transform(F.reverse(user_stack), user),
        F.transform(F.reverse(kernel_stack), lambda f: F.coalesce(F.nullif(f["function_name"], F.lit("")),
                                                                  F.lit("[kernel]"))))
    frames = F.when(F.size(frames) > 0, frames).otherwise(F.array(F.lit("[no stack]")))
    return F.concat(F.array(comm), frames)


def sample_paths(samples: DataFrame, offcpu: bool = False, keys=()) -> DataFrame:
    """Root-first name path and total weight of each distinct stack."""
    count = F.coalesce(F.nullif("count", F.lit(0)), F.lit(1)).cast("bigint")
    weight = count
    if offcpu:
        spent = F.coalesce(F.col("duration_ns"), F.lit(0))
        rounded = C.int_div(spent + F.lit(500), 1000)
        weight = F.when(spent != 0, F.greatest(F.lit(1).cast("bigint"), rounded)).otherwise(count)
    names = _names(samples, keys)
    raw = (samples.select(*keys, "comm", "user_stack", "kernel_stack", weight.alias("weight"))
           .groupBy(*names, "comm", "user_stack", "kernel_stack")
           .agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("samples")))
    empty = F.array().cast("array<struct<function_name:string>>")
    frames = {k: F.coalesce(F.transform(k, lambda f: F.struct(f["function_name"].alias("function_name"))), empty)
              for k in ("user_stack", "kernel_stack")}
    path = _path(F.col("comm"), frames["user_stack"], frames["kernel_stack"])
    return (raw.select(*names, path.alias("path"), "weight", "samples").groupBy(*names, "path")
            .agg(F.sum("weight").alias("weight"), F.sum("samples").alias("samples")))


def _names(df, keys):
    return df.select(*keys).columns if keys else []


def _tree_nodes(paths: DataFrame, names) -> tuple[DataFrame, DataFrame]:
    """Nodes of the tree without their paths, and the stacks that they come from.

    A node's id is a running hash of the names down to it (two numbers, so that ids don't collide), so a stack is
    shuffled as one short row per level; each node names one stack (``__sa``, ``__sb``) that passes through it.
    """
    def step(acc, name):
        last = F.element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.struct(F.xxhash64(F.lit(1), last["a"], name).alias("a"), F.xxhash64(F.lit(2), last["b"], name).alias("b"))))
    zero = F.lit(0).cast("bigint")
    ids = F.aggregate("path", F.array(F.struct(zero.alias("a"), zero.alias("b"))), step)
    stacks = paths.withColumn("__ids", ids).withColumn("__leaf", F.element_at("__ids", F.lit(-1)))
    levels = F.arrays_zip(F.col("__ids").alias("id"), F.concat(F.array(F.lit(ROOT)), F.col("path")).alias("name"))
    rows = stacks.select(*names, "weight", F.size("path").alias("__size"), F.col("__leaf.a").alias("__sa"), F.col("__leaf.b").alias("__sb"), F.posexplode(levels).alias("depth", "__n"))
    own = F.when(F.col("depth") == F.col("__size"), F.col("weight")).otherwise(0)
    nodes = (rows.groupBy(*names, F.col("__n.id.a").alias("__a"), F.col("__n.id.b").alias("__b"))
             .agg(F.sum("weight").alias("value"), F.sum(own).alias("self_value"), F.first("__n.name").alias("name"), F.first("depth").alias("depth"),
                  F.first("__sa").alias("__sa"), F.first("__sb").alias("__sb")))
    return nodes, stacks


def flame_tree(samples: DataFrame, offcpu: bool = False, keys=()) -> DataFrame:
    """Tree as a table: ``path``, ``depth``, ``name``, inclusive ``value`` and ``self_value``.

    The root has an empty path and depth 0.  A node takes its path from the one stack that it names, so shuffled bytes
    grow with the depth of stacks and not with its square.
    """
    names = _names(samples, keys)
    nodes, stacks = _tree_nodes(sample_paths(samples, offcpu, keys), names)
    # never null, and said so: a filter on the hash of a path would be moved to the scan and hash every sample
    ends = [F.coalesce(F.col(f"__leaf.{x}"), F.lit(0).cast("bigint")).alias(f"__l{x}") for x in ("a", "b")]
    full = stacks.select(*[F.col(n).alias(f"__k{i}") for i, n in enumerate(names)], *ends, F.col("path").alias("__full"))
    same = C.all_of([F.col("__sa") == F.col("__la"), F.col("__sb") == F.col("__lb")] + [F.col(n).eqNullSafe(F.col(f"__k{i}")) for i, n in enumerate(names)])
    return nodes.join(full, same).select(*names, F.slice("__full", F.lit(1), F.col("depth")).alias("path"), "depth", "name", "value", "self_value")


def profile_snapshots(samples: DataFrame, window="5 seconds", keep: int | None = None,
                      start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """One row per snapshot window and profile type: tree nodes (root included), samples, total.

    ``keep`` names the newest windows of each host and type; trees are built for those alone.
    """
    if start_ns is not None:
        samples = samples.where(F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        samples = samples.where(F.col("timestamp_ns") <= end_ns)
    w = C.duration_ns(window)
    keyed = samples.withColumn("window_ns", C.floor_to("timestamp_ns", w))
    keys = ["host", "sample_type", "window_ns"]
    if keep is not None:
        newest = top_per_key(keyed.select(*keys).distinct(), keys[:2], [F.col("window_ns").desc()], keep)
        keyed = keyed.join(newest, keys, "left_semi")
    tree, _ = _tree_nodes(sample_paths(keyed, keys=keys), keys)
    nodes = tree.groupBy(*keys).agg(F.count(F.lit(1)).alias("node_count"),
                                    F.max(F.when(F.col("depth") == 0, F.col("value"))).alias("value"))
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    return nodes.join(sizes, keys)


def function_totals(tree: DataFrame) -> DataFrame:
    """Inclusive value by name over all nodes (each level of a recursion counts)."""
    return tree.groupBy("name").agg(F.sum("value").alias("value"))


def profile_diff(base: DataFrame, comp: DataFrame) -> DataFrame:
    """Base and compare value of every function name, with the change in percent."""
    b = function_totals(base).where(F.col("name") != ROOT).withColumnRenamed("value", "base_value")
    c = function_totals(comp).where(F.col("name") != ROOT).withColumnRenamed("value", "comp_value")
    out = b.join(c, "name", "full_outer").select(
        "name", F.coalesce("base_value", F.lit(0)).alias("base_value"),
        F.coalesce("comp_value", F.lit(0)).alias("comp_value"))
    change = F.when(F.col("base_value") > 0,
                    100.0 * (F.col("comp_value") - F.col("base_value")) / F.col("base_value")) \
        .when(F.col("comp_value") > 0, 100.0).otherwise(0.0)
    return out.withColumn("change_pct", change)


def diff_summary(diff: DataFrame) -> DataFrame:
    b, c = F.col("base_value"), F.col("comp_value")
    return diff.agg(F.count(F.lit(1)).alias("total"), F.count_if(c > b).alias("increased"),
                    F.count_if(c < b).alias("decreased"), F.count_if((b == 0) & (c > 0)).alias("new"),
                    F.count_if((b > 0) & (c == 0)).alias("removed"))


def diff_flame(base_tree: DataFrame, comp_tree: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Compare tree with the name-level relative change of each node and its class."""
    b = function_totals(base_tree).withColumnRenamed("value", "__b")
    c = function_totals(comp_tree).withColumnRenamed("value", "__c")
    totals = c.join(b, "name", "left").select(
        "name", F.col("__c"), F.coalesce("__b", F.lit(0)).alias("__b"))
    change = F.when(F.col("__b") > 0, (F.col("__c") - F.col("__b")) / F.col("__b")) \
        .when(F.col("__c") > 0, 1.0).otherwise(0.0)
    delta = F.when(F.col("depth") == 0, 0.0).otherwise(change)
    out = comp_tree.join(totals, "name").withColumn("delta", delta).drop("__b", "__c")
    label = F.when(F.abs("delta") < threshold, "unchanged").when(F.col("delta") > 0, "regression") \
        .otherwise("improvement")
    return out.withColumn("change", label)


def folded_stacks(samples: DataFrame) -> DataFrame:
    """``comm;root;...;leaf`` over user frames, with summed counts; samples without any name are skipped."""
    frames = F.transform(F.reverse("user_stack"), lambda f: F.concat(F.lit(";"), C.frame_hex(f)))
    stack = F.concat(F.coalesce("comm", F.lit("")), F.coalesce(F.array_join(frames, ""), F.lit("")))
    # a sample without comm and frames has no name; said in cheap terms, since Spark moves this filter to the scan
    named = (F.coalesce("comm", F.lit("")) != "") | (F.size("user_stack") > 0)
    raw = samples.where(named).groupBy("comm", "user_stack").agg(F.sum("count").alias("count"))
    return raw.select(stack.alias("stack"), "count").groupBy("stack").agg(F.sum("count").alias("count"))
