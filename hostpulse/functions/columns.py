"""Scalar helpers: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

ADDRESS = "decimal(20,0)"
_TWO_63 = "9223372036854775808"
_TWO_64 = "18446744073709551616"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- names and text -------------------------------------------------------------------------

def sanitize_metric_name(c) -> Column:
    """Replace everything outside ``[A-Za-z0-9_]`` by ``_``."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9_]", "_")


def escape_label(c) -> Column:
    """Escape backslash, double quote and newline for the exposition text format."""
    escaped = F.replace(_col(c), F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit('"'), F.lit('\\"'))
    return F.replace(escaped, F.lit("\n"), F.lit("\\n"))


def parse_csv_list(c, type: str = "string") -> Column:
    """Comma list to array: blanks trimmed, empty and unparsable items dropped."""
    items = F.transform(F.split(_col(c), ","), lambda x: F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    items = F.filter(items, lambda x: x != "")
    if type == "string":
        return items
    return F.filter(F.transform(items, lambda x: x.try_cast(type)), lambda x: x.isNotNull())


def labels_key(labels) -> Column:
    """Order-free group key of a label map: entries sorted by label name."""
    return F.array_sort(F.map_entries(_col(labels)))


def labels_text(entries, fmt: str = "{k}={v};") -> Column:
    """Text of a sorted entry array, one piece per label."""
    before, rest = fmt.split("{k}")
    between, after = rest.split("{v}")
    pieces = F.transform(_col(entries), lambda e: F.concat(
        F.lit(before), e["key"], F.lit(between), e["value"], F.lit(after)))
    return F.array_join(pieces, "")


# --- numbers --------------------------------------------------------------------------------

def to_gauge(v) -> Column:
    """VARIANT to gauge value: booleans 1/0, numbers kept, strings and nulls 0."""
    v = _col(v)
    kind = F.schema_of_variant(v)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
        .when(kind != "STRING", F.try_variant_get(v, "$", "double")),
        F.lit(0.0))


def agg_numeric(v) -> Column:
    """VARIANT to aggregatable number: booleans, strings and nulls become NULL."""
    v = _col(v)
    kind = F.schema_of_variant(v)
    return F.when(~kind.isin("BOOLEAN", "STRING", "VOID"), F.try_variant_get(v, "$", "double"))


def round_half_up(c) -> Column:
    """Chart rounding: halves go towards positive infinity."""
    return F.floor(_col(c) + F.lit(0.5))


def ratio(num, den, default=0.0) -> Column:
    """Double division that yields ``default`` where the denominator is 0 or NULL."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den != 0, num / den).otherwise(F.lit(default))


# --- time -----------------------------------------------------------------------------------

def ns_to_ts(ns) -> Column:
    return F.timestamp_micros(int_div(ns, 1000))


def ts_to_ns(ts) -> Column:
    return F.unix_micros(_col(ts)) * F.lit(1000)


def us(ns) -> Column:
    """Whole microseconds."""
    return int_div(ns, 1000)


def ms(ns) -> Column:
    """Whole milliseconds."""
    return int_div(ns, 1_000_000)


def int_div(c, n: int) -> Column:
    """Integral division of a non-negative whole-number column, exact beyond 2^53."""
    return F.call_function("div", _col(c), F.lit(n).cast("bigint"))


def floor_to(c, step: int) -> Column:
    """Start of the ``step``-wide bucket that holds ``c``."""
    c = _col(c)
    return c - F.pmod(c, F.lit(step).cast("bigint"))


def duration_ns(text) -> int:
    """``'10 seconds'`` or nanoseconds as int -> nanoseconds."""
    if isinstance(text, int):
        return text
    units = {"ns": 1, "us": 10**3, "ms": 10**6, "second": 10**9, "minute": 60 * 10**9,
             "hour": 3600 * 10**9, "day": 86400 * 10**9}
    number, unit = str(text).split()
    unit = unit if unit in units else unit.rstrip("s")
    return int(float(number) * units[unit])


# --- frames and addresses -------------------------------------------------------------------

def address_hex(address) -> Column:
    """Lower-case hex digits of an unsigned 64-bit address held as DECIMAL(20,0)."""
    a = _col(address).cast("decimal(21,0)")
    signed = F.when(a >= F.lit(_TWO_63).cast("decimal(21,0)"), a - F.lit(_TWO_64).cast("decimal(21,0)")).otherwise(a)
    return F.lower(F.hex(signed.cast("bigint")))


def address_position(address) -> Column:
    """An unsigned 64-bit address as BIGINT in the same order: cheaper to hash, sort and move than the decimal."""
    return (_col(address).cast("decimal(21,0)") - F.lit(_TWO_63).cast("decimal(21,0)")).cast("bigint")


def position_address(position) -> Column:
    """The address at a position of ``address_position``."""
    return (_col(position).cast("decimal(21,0)") + F.lit(_TWO_63).cast("decimal(21,0)")).cast(ADDRESS)


def position_hex(position) -> Column:
    """``address_hex`` of the address at a position."""
    return F.lower(F.hex(_col(position).bitwiseXOR(F.lit(-2**63).cast("bigint"))))


def parse_hex(text) -> Column:
    """Hex digits to DECIMAL(20,0)."""
    return F.conv(_col(text), 16, 10).cast(ADDRESS)


def frame_label(frame: Column, kind: str) -> Column:
    """Merge key of a frame: its name, or ``k:``/``u:`` and the decimal address."""
    fallback = F.concat(F.lit(f"{kind}:"), F.coalesce(frame["address"], F.lit(0).cast(ADDRESS)).cast("string"))
    return F.coalesce(F.nullif(frame["function_name"], F.lit("")), fallback)


def frame_hex(frame: Column) -> Column:
    """Name of a frame, or ``0x`` and the hex address."""
    return F.coalesce(F.nullif(frame["function_name"], F.lit("")), F.concat(F.lit("0x"), address_hex(frame["address"])))


def frame(name: Column, address: Column | None = None) -> Column:
    """Frame struct from a name and an address."""
    return F.struct((F.lit(0) if address is None else address).cast(ADDRESS).alias("address"),
                    name.alias("function_name"), F.lit("").alias("file_name"),
                    F.lit(0).cast("bigint").alias("line_number"), F.lit("").alias("module_name"))


def frames_from_addresses(addresses) -> Column:
    """Address array -> array of unnamed frames."""
    return F.transform(_col(addresses), lambda a: frame(F.lit(""), a))


def frames_from_names(names) -> Column:
    """Name array -> array of frames without address."""
    return F.transform(_col(names), lambda n: frame(n))


# --- codes ----------------------------------------------------------------------------------

def event_type_name(c) -> Column:
    """Scheduler event code to name; unknown codes read as ``switch``."""
    c = _col(c)
    return F.when(c == 1, "wakeup").when(c == 2, "migrate").otherwise("switch")


def ipv4_to_string(c) -> Column:
    """Dotted text of an address in network byte order (first octet in the lowest byte)."""
    c = _col(c)
    octets = [F.shiftright(c, s).bitwiseAND(F.lit(255)).cast("string") for s in (0, 8, 16, 24)]
    return F.concat_ws(".", *octets)


def core_sort_key(c) -> Column:
    """Last run of digits in a core name, 0 without digits."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(c), r"(\d+)\D*$", 1), F.lit("")).cast("bigint"), F.lit(0))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
