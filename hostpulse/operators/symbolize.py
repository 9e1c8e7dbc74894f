"""Symbol names for stack addresses.

Names are looked up once per *distinct* address and written back once per distinct stack; the
samples themselves meet the result in a single equi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hostpulse.functions import columns as C
from hostpulse.operators.ordered import asof, ordinal

CODE_TYPES = ("t", "T", "w", "W")
SYMBOL_TYPES = ("FUNC", "IFUNC", "OBJECT")
ADDRESS_SLICE = 1 << 20


def prepare_symbols(symbols: DataFrame) -> DataFrame:
    """Usable symbols: functions and objects with a name and a value or size."""
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    return symbols.where(F.col("type").isin(*SYMBOL_TYPES) & named & ~((F.col("value") == 0) & (F.col("size") == 0)))


def _kernel_names(positions: DataFrame, kernel_symbols: DataFrame, slice_width: int) -> DataFrame:
    """Name of each distinct (host, ``__p``), where ``__p`` is the position of an address."""
    distinct = positions.where(F.col("__p") != F.lit(-2**63).cast("bigint")).distinct()
    code = kernel_symbols.where(F.col("type").isin(*CODE_TYPES)) if "type" in kernel_symbols.columns \
        else kernel_symbols
    code = code.select("host", "name", C.address_position("address").alias("__at"))
    hit = asof(distinct, code, ["host"], "__p", "__at", ["name"], "__s", slice_width)
    fallback = F.concat(F.lit("[kernel 0x"), C.position_hex("__p"), F.lit("]"))
    return hit.select("host", "__p", F.coalesce(F.nullif("__s.name", F.lit("")), fallback).alias("name"))


def kernel_names(addresses: DataFrame, kernel_symbols: DataFrame, slice_width: int = ADDRESS_SLICE) -> DataFrame:
    """Name of each distinct (host, address): the symbol at or below it, else ``[kernel 0x...]``."""
    names = _kernel_names(addresses.select("host", C.address_position("address").alias("__p")), kernel_symbols, slice_width)
    address = C.position_address("__p").cast(addresses.schema["address"].dataType)
    return names.select("host", address.alias("address"), "name")


def _bits(op: str, value, n):
    return F.call_function(op, value, n)


def _blocks(maps: DataFrame) -> DataFrame:
    """Rows ``__level``, ``__block`` for each map: the aligned blocks of 2^level addresses that it consists of.

    A map of n addresses is at most two blocks of each size up to n, and exactly one of them holds any address of it.
    """
    most = F.least(F.lit(63), (F.floor(F.log2((F.col("end") - F.col("start")).cast("double"))) + 1).cast("int"))
    rows = maps.withColumn("__level", F.explode(F.sequence(F.lit(0), most)))

    level, high = F.col("__level"), _bits("shiftleft", F.lit(-1).cast("bigint"), F.col("__level"))
    first, last = _bits("shiftright", F.col("__lo"), level), _bits("shiftright", F.col("__hi"), level)
    # only blocks that lie in the map as a whole: its first address has no low bits, its last one all of them
    first = F.when(F.col("__lo").bitwiseAND(high) == F.col("__lo"), first).otherwise(first + 1)
    last = F.when(F.col("__hi").bitwiseOR(high) == -1, last).otherwise(last - 1)
    rows = rows.withColumn("__first", first).withColumn("__last", last).where(F.col("__first") <= F.col("__last"))
    odd, even = F.col("__first").bitwiseAND(1) == 1, F.col("__last").bitwiseAND(1) == 0
    after = F.when(odd, F.col("__first") + 1).otherwise(F.col("__first"))
    ends = F.array(F.when(odd, F.col("__first")), F.when(even & (after <= F.col("__last")), F.col("__last")))
    return rows.withColumn("__block", F.explode(ends)).where(F.col("__block").isNotNull()).drop("__first", "__last")


def flatten_maps(proc_maps: DataFrame) -> DataFrame:
    """Address-space maps cut into disjoint pieces, each owned by the first map that covers it.

    Maps of a process that touch no others are pieces as they are.  Those that overlap are cut at all their borders, and
    a piece finds its owner among the aligned blocks of addresses around its start, of which each keeps its first map:
    the work follows the number of maps, however many of them overlap.  The kernel bounds the maps of a process.
    """
    unique = (proc_maps.where(F.col("start") < F.col("end")).groupBy("host", "pid", "start", "end", "offset", "path")
              .agg(F.min("ord").alias("ord")))
    in_order = Window.partitionBy("host", "pid").orderBy("start", "end", "ord")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = unique.withColumn("__new", reached.isNull() | (F.col("start") >= reached))
    lone = begins.withColumn("__lone", F.col("__new") & F.coalesce(F.lead("__new").over(in_order), F.lit(True)))
    alone = lone.where(F.col("__lone")).select("host", "pid", "path", F.col("start").alias("piece"), F.col("end").alias("piece_end"), "start", "offset")
    maps = lone.where(~F.col("__lone")).select("host", "pid", "start", "end", F.struct("ord", "start", "end", "offset", "path").alias("__m"))

    blocks = (_blocks(maps.select("host", "pid", "start", "end", "__m", ordinal(maps, "start").alias("__lo"), ordinal(maps, "end", -1).alias("__hi")))
              .groupBy(F.col("host").alias("__host"), F.col("pid").alias("__pid"), "__level", "__block").agg(F.min("__m").alias("__m")))
    edges = maps.select("host", "pid", F.explode(F.array("start", "end")).alias("piece")).distinct()
    following = Window.partitionBy("host", "pid").orderBy("piece")
    pieces = edges.withColumn("piece_end", F.lead("piece").over(following)).where(F.col("piece_end").isNotNull())
    same = F.col("host").eqNullSafe(F.col("__host")) & F.col("pid").eqNullSafe(F.col("__pid"))
    sizes = blocks.groupBy("__host", "__pid").agg(F.collect_set("__level").alias("__levels"))
    around = (pieces.withColumn("__lo", ordinal(pieces, "piece")).join(sizes, same).drop("__host", "__pid")
              .withColumn("__l", F.explode("__levels")).withColumn("__b", _bits("shiftright", F.col("__lo"), F.col("__l"))))
    owned = (around.join(blocks, same & (F.col("__l") == F.col("__level")) & (F.col("__b") == F.col("__block")))
             .groupBy("host", "pid", "piece", "piece_end").agg(F.min("__m").alias("__m")))
    return alone.unionByName(owned.select("host", "pid", "__m.path", "piece", "piece_end", "__m.start", "__m.offset"))


def user_names(addresses: DataFrame, proc_maps: DataFrame, elf_symbols: DataFrame,
               slice_width: int = ADDRESS_SLICE) -> DataFrame:
    """Name of each distinct (host, pid, address).

    Covering map -> file offset -> greatest symbol at or below it whose size covers it; a file with
    symbols but no hit gives ``[path+0x...]``, anything else ``[0x...]``.
    """
    distinct = addresses.select("host", "pid", "address").where(F.col("address") != 0).distinct()
    maps = flatten_maps(proc_maps)
    placed = asof(distinct, maps, ["host", "pid"], "address", "piece", ["piece_end", "start", "offset", "path"],
                  "__m", slice_width)
    inside = F.col("address") < F.col("__m.piece_end")
    placed = placed.withColumn("__m", F.when(inside, F.col("__m"))).select(
        "host", "pid", "address", F.col("__m.path").alias("path"),
        (F.col("address") - F.col("__m.start")).cast(C.ADDRESS).alias("delta"),
        (F.col("address") - F.col("__m.start") + F.col("__m.offset")).cast(C.ADDRESS).alias("file_offset"))
    symbols = prepare_symbols(elf_symbols)
    # addresses outside every map share no key, so they don't meet in the joins below
    plain = F.concat(F.lit("[0x"), C.address_hex("address"), F.lit("]"))
    outside = placed.where(F.col("path").isNull()).select("host", "pid", "address", plain.alias("name"))
    placed = placed.where(F.col("path").isNotNull())
    # the same file offset is looked up once for all hosts and processes
    offsets = placed.select("path", "file_offset").distinct()
    found = asof(offsets, symbols, ["path"], "file_offset", "value", ["value", "size", "name"], "__s", slice_width)
    covers = (F.col("__s.size") == 0) | (F.col("file_offset") < F.col("__s.value") + F.col("__s.size"))
    found = found.select("path", "file_offset", F.when(covers, F.col("__s.name")).alias("symbol"))
    readable = symbols.select("path").distinct().withColumn("readable", F.lit(True))
    named = placed.join(found, ["path", "file_offset"], "left").join(readable, "path", "left")
    in_file = F.when(F.col("readable"), F.concat(F.lit("["), F.col("path"), F.lit("+0x"), C.address_hex("delta"),
                                                 F.lit("]")))
    return named.select("host", "pid", "address", F.coalesce("symbol", in_file, plain).alias("name")).unionByName(outside)


def _demangled(names: DataFrame, demangle) -> DataFrame:
    if demangle is None:
        return names
    distinct = names.select("name").distinct().withColumn("__d", demangle(F.col("name")))
    return names.join(distinct, "name").withColumn("name", F.coalesce("__d", "name")).drop("__d")


def _stacks(samples: DataFrame, stack: str, keys) -> DataFrame:
    """Distinct stacks as arrays ``__a`` of address positions.  Addresses are looked up and names written back for these.

    Empty stacks are kept and exploded as outer rows: filters on the array, also those that a plain explode brings along,
    would build it again for every sample and differ between the two uses, which then could not share one shuffle.
    """
    return samples.select(*keys, _positions(stack).alias("__a")).distinct()


def _positions(stack: str):
    return F.transform(stack, lambda f: C.address_position(f["address"]))


def _addresses(stacks: DataFrame, keys) -> DataFrame:
    return stacks.select(*keys, F.explode_outer("__a").alias("__p"))


def _apply_names(samples: DataFrame, stack: str, keys, stacks: DataFrame, names: DataFrame) -> DataFrame:
    """Fill ``function_name`` of one stack column; frames with address 0 keep what they have."""
    keys = list(keys)
    keyed = samples.withColumn("__a", _positions(stack)).withColumn("__g", F.xxhash64(*keys, "__a"))
    frames = stacks.select(*keys, F.xxhash64(*keys, "__a").alias("__h"), "__a", F.posexplode_outer("__a").alias("__pos", "__p"))
    names = names.select(F.col("__p").alias("__q"), "name", *[F.col(k).alias(f"__k_{k}") for k in keys])
    # null keys meet too, as in the lookup; a plain join would filter them from one use of the stacks only
    here = C.all_of([F.col("__p") == F.col("__q")] + [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    # a stack has at most as many frames as the sampler's depth limit
    named = (frames.join(names, here, "left").groupBy("__h", *keys, "__a")
             .agg(F.array_sort(F.collect_list(F.struct("__pos", "name"))).alias("__n"))
             .select("__h", *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__a").alias("__b"), "__n"))
    # rows meet by one number, keys and addresses only confirm: as terms of least() they don't become sort keys of the join
    same = F.least(*[F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__a").eqNullSafe(F.col("__b")))
    out = keyed.join(named, (F.col("__g") == F.col("__h")) & same, "left")
    renamed = F.zip_with(F.col(stack), F.col("__n"), lambda f, n: F.struct(
        f["address"].alias("address"), F.coalesce(n["name"], f["function_name"]).alias("function_name"),
        f["file_name"].alias("file_name"), f["line_number"].alias("line_number"),
        f["module_name"].alias("module_name")))
    return out.withColumn(stack, F.when(F.size(stack) > 0, renamed).otherwise(F.col(stack))).select(*samples.columns)


def symbolize_kernel(samples: DataFrame, kernel_symbols: DataFrame, demangle=None,
                     slice_width: int = ADDRESS_SLICE) -> DataFrame:
    stacks = _stacks(samples, "kernel_stack", ["host"])
    names = _kernel_names(_addresses(stacks, ["host"]), kernel_symbols, slice_width)
    return _apply_names(samples, "kernel_stack", ["host"], stacks, _demangled(names, demangle))


def symbolize_user(samples: DataFrame, proc_maps: DataFrame, elf_symbols: DataFrame, demangle=None,
                   slice_width: int = ADDRESS_SLICE) -> DataFrame:
    keys = ["host", "pid"]
    stacks = _stacks(samples, "user_stack", keys)
    addresses = _addresses(stacks, keys).select(*keys, C.position_address("__p").alias("address"))
    names = user_names(addresses, proc_maps, elf_symbols, slice_width)
    names = names.select(*keys, C.address_position("address").alias("__p"), "name")
    return _apply_names(samples, "user_stack", keys, stacks, _demangled(names, demangle))
