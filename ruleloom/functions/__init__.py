"""Functions of the rule language as Spark columns.

``call(name, columns, literals)`` gives a column.  A name without an entry here
is looked up among Spark's own functions by rule: ``CharLength`` is
``char_length``.  Aggregates are functions like the others; where they stand
decides over what they aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ruleloom.lang.ast import ProgramError

Function = Callable[..., Column]
TABLE: dict[str, Function] = {}
#: Names that aggregate, besides user functions over them.
AGGREGATES: set[str] = set()
#: Functions that also get their arguments' literal values (None where not literal).
WITH_LITERALS: set[str] = set()
#: Value of an aggregate over no rows, where that isn't null.
OF_NOTHING = {"Count": 0, "ExactCount": 0, "ApproxCountDistinct": 0, "Countif": 0}


def define(*names: str, aggregate: bool = False, literals: bool = False):
    def add(f: Function) -> Function:
        for n in names:
            TABLE[n] = f
            if aggregate:
                AGGREGATES.add(n)
            if literals:
                WITH_LITERALS.add(n)
        return f

    return add


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def spark_name(name: str) -> str:
    """Spark's function for a camel-cased name, by rule and a few exceptions."""
    return RENAMED.get(name, snake(name))


#: Names whose Spark function has another name.
RENAMED = {
    "ArrayLength": "size", "ArrayReverse": "reverse", "ArrayToString": "array_join", "ByteLength": "octet_length", "Div": "div",
    "EndsWith": "endswith", "FromBase64": "unbase64", "FromHex": "unhex", "GenerateUuid": "uuid", "HllCountExtract": "hll_sketch_estimate",
    "HllCountInit": "hll_sketch_agg", "HllCountMergePartial": "hll_union_agg", "IsNan": "isnan", "JsonExtract": "get_json_object",
    "JsonQuery": "get_json_object", "Pow": "pow", "RegexpContains": "regexp_like", "RegexpMatch": "regexp_like", "RMatch": "regexp_like",
    "SafeAdd": "try_add", "SafeDivide": "try_divide", "SafeMultiply": "try_multiply", "SafeSubtract": "try_subtract",
    "SafeConvertBytesToString": "make_valid_utf8", "StAsbinary": "st_asbinary", "StGeogfromwkb": "st_geogfromwkb", "StartsWith": "startswith",
    "Strpos": "instr", "TimestampFromUnixMicros": "timestamp_micros", "TimestampFromUnixMillis": "timestamp_millis",
    "TimestampFromUnixSeconds": "timestamp_seconds", "ToBase64": "base64", "CurrentDatetime": "localtimestamp", "Sqrt": "sqrt",
}

for _n in "AnyValue ApproxCountDistinct Avg BitAnd BitOr BitXor Corr CovarPop CovarSamp Max Min StddevPop StddevSamp Sum VarPop VarSamp HllCountInit HllCountMergePartial".split():
    AGGREGATES.add(_n)

# operators

define("+")(lambda a, b: a + b)
define("*")(lambda a, b: a * b)
define("/")(lambda a, b: F.try_divide(a, b))
define("%", "Mod")(lambda a, b: F.try_mod(a, b))
define("^")(lambda a, b: F.pow(a, b))
define("++", "ArrayConcat")(lambda *a: F.concat(*a))
define("==", "=")(lambda a, b: a == b)
define("!=")(lambda a, b: a != b)
define("<")(lambda a, b: a < b)
define("<=")(lambda a, b: a <= b)
define(">")(lambda a, b: a > b)
define(">=")(lambda a, b: a >= b)
define("&&")(lambda a, b: a & b)
define("||")(lambda a, b: a | b)
define("!")(lambda a: ~a)
define("is")(lambda a, b: a.eqNullSafe(b))
define("is not")(lambda a, b: ~a.eqNullSafe(b))
define("in")(lambda a, b: F.array_contains(b, a))
define("->")(lambda a, b: F.struct(a.alias("arg"), b.alias("value")))
define("IsNull")(lambda a: a.isNull())
define("Like")(lambda a, b: F.call_function("like", a, b))
define("ILike")(lambda a, b: F.call_function("ilike", a, b))
define("Constraint", "Num", "Str", "MagicalEntangle")(lambda a, *_: a)


@define("-")
def minus(a: Column, b: Column | None = None) -> Column:
    return -a if b is None else a - b


# aggregates

define("Sum", "ISum", aggregate=True)(lambda x: F.sum(x))
define("Count", "ExactCount", aggregate=True)(lambda x: F.count_distinct(x))
define("Countif", aggregate=True)(lambda x: F.count_if(x))
define("SomeValue", aggregate=True)(lambda x: F.any_value(x, F.lit(True)))
define("Median", aggregate=True)(lambda x: F.median(x))
define("LogicalAnd", aggregate=True)(lambda x: F.bool_and(x))
define("LogicalOr", aggregate=True)(lambda x: F.bool_or(x))


def _some(listed: Column) -> Column:
    """A list, or null over no rows."""
    return F.when(F.count(F.lit(1)) > 0, listed)


@define("List", "ArrayAgg", aggregate=True)
def list_(x: Column) -> Column:
    """Null elements stay, unlike in Spark's own list aggregate."""
    return _some(F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"]))


define("Set", aggregate=True)(lambda x: _some(F.sort_array(F.collect_set(x))))
define("ArrayConcatAgg", "MergeList", aggregate=True)(lambda x: F.when(F.count(x) > 0, F.flatten(F.collect_list(x))))
define("StringAgg", aggregate=True)(lambda x, sep=None: F.when(F.count(x) > 0, F.array_join(F.collect_list(x), ",") if sep is None else F.call_function("array_join", F.collect_list(x), sep)))
# ties go to the least argument
define("ArgMin", aggregate=True)(lambda p: F.min(F.struct(p["value"].alias("v"), p["arg"].alias("a")))["a"])
define("ArgMax", aggregate=True)(lambda p: F.max(F.struct(p["value"].alias("v"), p["arg"].alias("a")))["a"])
define("Array", aggregate=True)(lambda p: _some(F.transform(F.array_sort(F.collect_list(F.struct(p["arg"].alias("k"), p["value"].alias("v")))), lambda s: s["v"])))


def _top(p: Column, k: Column, ascending: bool) -> Column:
    both = F.collect_list(F.struct(p["value"].alias("v"), p["arg"].alias("a")))
    return _some(F.slice(F.transform(F.sort_array(both, asc=ascending), lambda s: s["a"]), F.lit(1), k.cast("int")))


define("ArgMinK", aggregate=True)(lambda p, k: _top(p, k, True))
define("ArgMaxK", aggregate=True)(lambda p, k: _top(p, k, False))
define("ApproxQuantiles", aggregate=True, literals=True)(lambda x, n, literals: F.percentile_approx(x, [i / literals[1] for i in range(literals[1] + 1)]))
define("ApproxTopCount", aggregate=True, literals=True)(lambda x, k, literals: F.transform(F.call_function("approx_top_k", x, F.lit(int(literals[1]))), lambda s: F.struct(s["item"].alias("value"), s["count"].alias("count"))))


@define("ApproxTopSum", aggregate=True)
def approx_top_sum(x: Column, weight: Column, k: Column) -> Column:
    """The k values of the largest summed weights, exactly; a group's distinct values are held in one map."""
    pairs = F.collect_list(F.struct(x.alias("value"), weight.cast("double").alias("sum")))
    values = F.array_distinct(F.transform(pairs, lambda p: p["value"]))
    sums = F.transform(values, lambda v: F.struct(v.alias("value"), F.aggregate(F.filter(pairs, lambda p: p["value"] == v), F.lit(0.0), lambda s, p: s + p["sum"]).alias("sum")))
    ordered = F.array_sort(sums, lambda a, b: F.when(a["sum"] > b["sum"], -1).when(a["sum"] < b["sum"], 1).when(a["value"] < b["value"], -1).otherwise(1))
    return F.slice(ordered, F.lit(1), k.cast("int"))


define("HllCountMerge", aggregate=True)(lambda x: F.hll_sketch_estimate(F.hll_union_agg(x)))
define("PercentileCont", aggregate=True, literals=True)(lambda x, p, literals: F.percentile(x, literals[1]))
define("PercentileDisc", aggregate=True, literals=True)(lambda x, p, literals: F.percentile_approx(x, literals[1], 1_000_000))

# windows: value, partition list, order list


def _window(partition: list[Column], order: list[Column]):
    return Window.partitionBy(*partition).orderBy(*order)


WINDOWS = {
    "CumulativeSum": lambda v, w, n: F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "CumulativeMax": lambda v, w, n: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "CumulativeMin": lambda v, w, n: F.min(v).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    "WindowSum": lambda v, w, n: F.sum(v).over(w.rowsBetween(-n, 0)),
    "WindowMax": lambda v, w, n: F.max(v).over(w.rowsBetween(-n, 0)),
    "WindowMin": lambda v, w, n: F.min(v).over(w.rowsBetween(-n, 0)),
    "Lag": lambda v, w, n: F.lag(v, 1 if n is None else n).over(w),
    "Lead": lambda v, w, n: F.lead(v, 1 if n is None else n).over(w),
    "FirstValue": lambda v, w, n: F.first(v).over(w),
    "LastValue": lambda v, w, n: F.last(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    "NthValue": lambda v, w, n: F.nth_value(v, n).over(w),
    "Ntile": lambda v, w, n: F.ntile(n).over(w),
    "RowNumber": lambda v, w, n: F.row_number().over(w),
    "Rank": lambda v, w, n: F.rank().over(w),
    "DenseRank": lambda v, w, n: F.dense_rank().over(w),
    "PercentRank": lambda v, w, n: F.percent_rank().over(w),
    "CumeDist": lambda v, w, n: F.cume_dist().over(w),
}


def window(name: str, value: Column | None, partition: list[Column], order: list[Column], n: int | None) -> Column:
    return WINDOWS[name](value, _window(partition, order), n)


# conversions

define("ToFloat64")(lambda x: x.cast("double"))
define("ToInt64", "BitCastToInt64")(lambda x: x.cast("bigint"))
define("ToUInt64")(lambda x: x.cast("decimal(20,0)"))
define("ToString", "String")(lambda x, *_: x.cast("string"))
define("ToTime", "Timestamp")(lambda x, *_: x.cast("timestamp"))
define("BitCastToUint32")(lambda x: x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
define("BitCastToInt32")(lambda x: F.when(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) >= (1 << 31), x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) - (1 << 32)).otherwise(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).cast("int"))
define("BitCastToUint64")(lambda x: F.when(x < 0, x.cast("decimal(20,0)") + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(x.cast("decimal(20,0)")).cast("decimal(20,0)"))

#: Type names of casts and what Spark calls them.
TYPES = {"INT64": "bigint", "FLOAT64": "double", "BOOL": "boolean", "STRING": "string", "BYTES": "binary", "NUMERIC": "decimal(38,9)", "DATETIME": "timestamp_ntz", "TEXT": "string", "FLOAT": "double", "INTEGER": "bigint", "NUM": "double", "STR": "string"}


@define("Cast", literals=True)
def cast(x: Column, kind: Column, literals: list) -> Column:
    return x.cast(TYPES.get(str(literals[1]).upper(), str(literals[1])))


@define("TryCast", literals=True)
def try_cast(x: Column, kind: Column, literals: list) -> Column:
    return x.try_cast(TYPES.get(str(literals[1]).upper(), str(literals[1])))


# lists

define("Concat")(lambda *a: F.concat(*a))
define("Element")(lambda xs, i: F.get(xs, i.cast("int")))
define("Join")(lambda xs, sep: F.call_function("array_join", xs, sep))
define("JoinOrEmpty")(lambda xs, sep: F.coalesce(F.call_function("array_join", xs, sep), F.lit("")))
define("Range")(lambda n: F.when(n.isNull(), F.lit(None)).when(n > 0, F.sequence(F.lit(0).cast("bigint"), F.greatest(n.cast("bigint") - 1, F.lit(0).cast("bigint")))).otherwise(F.array().cast("array<bigint>")))
define("RangeOf")(lambda xs: TABLE["Range"](F.size(xs)))
define("Size")(lambda xs: F.size(xs).cast("bigint"))
define("Sort")(lambda xs: F.sort_array(xs))
define("Unique")(lambda xs: F.sort_array(F.array_distinct(xs)))
define("Split")(lambda s, sep=None: F.split(s, F.concat(F.lit("\\Q"), F.lit(",") if sep is None else sep, F.lit("\\E"))))
define("GenerateDateArray", "GenerateTimestampArray")(lambda a, b, *step: F.when(a <= b, F.sequence(a, b, *step)).otherwise(F.slice(F.array(a), 1, 0)))


@define("GenerateArray")
def generate_array(a: Column, b: Column, step: Column | None = None) -> Column:
    """Up or down by the sign of the step; null bounds or steps give null."""
    step = F.lit(1) if step is None else step
    on = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    return F.when(on.isNull(), F.lit(None)).when(on, F.sequence(a, b, step)).otherwise(F.slice(F.array(a), 1, 0))


define("RangeBucket")(lambda x, xs: F.size(F.filter(xs, lambda e: e <= x)))

# text

define("Format")(lambda fmt, *a: F.call_function("format_string", fmt, *a))
define("Length", "CharLength")(lambda s: F.char_length(s).cast("bigint"))
define("Log")(lambda x, base=None: F.ln(x) if base is None else F.ln(x) / F.ln(base))
define("JsonExtractScalar", "JsonValue")(lambda j, path: F.when(~F.coalesce(F.get_json_object(j, path) if isinstance(path, str) else F.call_function("get_json_object", j, path), F.lit("")).rlike(r"^\s*[\[{]"), F.call_function("get_json_object", j, path)))
define("RecordAsJson", "ToJsonString")(lambda r, *_: F.to_json(r))
define("AssembleRecord")(lambda pairs: F.map_from_entries(pairs))
define("DisassembleRecord")(lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("arg"), e["value"].alias("value"))))
define("Fingerprint")(lambda s: (F.conv(F.substring(F.md5(s.cast("string").cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")).cast("bigint"))
define("NaturalHash")(lambda x: F.xxhash64(x).bitwiseAND(F.lit((1 << 63) - 1).cast("bigint")))
define("FarmFingerprint")(lambda x: F.xxhash64(x))
define("Chr", "Char")(lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("int")), 8, "0")), "UTF-32"))
define("Ord")(lambda s: F.ascii(s))
define("CodePointsToString")(lambda xs: F.array_join(F.transform(xs, lambda x: TABLE["Chr"](x)), ""))
define("CodePointsToBytes")(lambda xs: F.unhex(F.array_join(F.transform(xs, lambda x: F.lpad(F.hex(x), 2, "0")), "")))
define("ToCodePoints")(lambda s: F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c)))
define("UniqueNumber", "UnsafeToUseUniqueNumber")(lambda: F.monotonically_increasing_id())
define("ProverChoice")(lambda slot, options: F.get(options, F.pmod(F.xxhash64(F.lit("choice"), slot), F.size(options)).cast("int")))
define("QuoteIt")(lambda s: F.concat(F.lit('"'), s, F.lit('"')))
define("RExtract")(lambda s, p, g: F.call_function("regexp_extract", s, p, g.cast("int")))


def _group(literals: list) -> int:
    """1 if the pattern has a group, else 0."""
    return 1 if re.search(r"(?<!\\)\((?!\?)", str(literals[1])) else 0


define("RegexpExtract", literals=True)(lambda s, p, literals: F.when(F.regexp_like(s, p), F.call_function("regexp_extract", s, p, F.lit(_group(literals)))))
define("RegexpExtractAll", literals=True)(lambda s, p, literals: F.call_function("regexp_extract_all", s, p, F.lit(_group(literals))))
define("RegexpReplace", "ReSub")(lambda s, p, r, *_: F.call_function("regexp_replace", s, p, F.regexp_replace(r, r"\\([0-9])", r"\$$1")))
define("Ltrim")(lambda s, c=None: F.ltrim(s) if c is None else F.call_function("ltrim", c, s))
define("Rtrim")(lambda s, c=None: F.rtrim(s) if c is None else F.call_function("rtrim", c, s))
define("Trim")(lambda s, c=None: F.trim(s) if c is None else F.call_function("btrim", s, c))
define("Substr")(lambda s, a, n=None: F.call_function("substr", s, a.cast("int"), *([] if n is None else [n.cast("int")])))
define("Lpad")(lambda s, n, p=None: F.call_function("lpad", s, n.cast("int"), F.lit(" ") if p is None else p))
define("Rpad")(lambda s, n, p=None: F.call_function("rpad", s, n.cast("int"), F.lit(" ") if p is None else p))
define("Repeat")(lambda s, n: F.repeat(s, n.cast("int")))
define("Md5")(lambda s: F.unhex(F.md5(s)))
define("Sha1")(lambda s: F.unhex(F.sha1(s)))
define("Sha256")(lambda s: F.unhex(F.sha2(s, 256)))
define("Sha512")(lambda s: F.unhex(F.sha2(s, 512)))
define("ToHex")(lambda b: F.lower(F.hex(b)))
define("Error")(lambda m: F.raise_error(m))
define("NetHost")(lambda u: F.parse_url(u, F.lit("HOST")))
define("NetIpv4FromInt64")(lambda n: F.unhex(F.lpad(F.hex(n), 8, "0")))
define("NetIpv4ToInt64")(lambda b: F.conv(F.hex(b), 16, 10).cast("bigint"))
define("AeadEncrypt")(lambda key, text, aad: F.call_function("aes_encrypt", text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad))
define("AeadDecryptBytes")(lambda key, text, aad: F.call_function("aes_decrypt", text, key, F.lit("GCM"), F.lit("DEFAULT"), aad))
define("AeadDecryptString")(lambda key, text, aad: TABLE["AeadDecryptBytes"](key, text, aad).cast("string"))

# numbers

define("If")(lambda c, a, b: F.when(c, a).otherwise(b))
define("Round")(lambda x, n=None: F.round(x) if n is None else F.call_function("round", x, n.cast("int")))
define("Trunc")(lambda x, n=None: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)) if n is None else F.when(x < 0, F.ceil(x * F.pow(F.lit(10.0), n))).otherwise(F.floor(x * F.pow(F.lit(10.0), n))) / F.pow(F.lit(10.0), n))
define("Floor")(lambda x: F.floor(x))
define("Ceil")(lambda x: F.ceil(x))
define("Div")(lambda a, b: F.when(b != 0, F.call_function("div", a.cast("bigint"), b.cast("bigint"))))
define("IeeeDivide")(lambda a, b: F.when(b.cast("double") == 0, F.when((a == 0) | F.isnan(a.cast("double")), F.lit(float("nan"))).otherwise(F.sign(a) * float("inf"))).otherwise(F.try_divide(a.cast("double"), b.cast("double"))))
define("IsInf")(lambda x: F.abs(x) == float("inf"))
define("SafeNegate")(lambda x: F.try_subtract(F.lit(0), x))


def _strict(f: Callable) -> Function:
    """Null if any argument is."""

    def of(*a: Column) -> Column:
        if len(a) == 1:
            return a[0]
        known = a[0].isNotNull()
        for x in a[1:]:
            known = known & x.isNotNull()
        return F.when(known, f(*a))

    return of


define("Least")(_strict(F.least))
define("Greatest")(_strict(F.greatest))

# dates and times

define("DateAddDay", "DateAdd")(lambda d, n: F.date_add(d, n.cast("int")))
define("DateSub")(lambda d, n: F.date_sub(d, n.cast("int")))
define("DateDiffDay")(lambda a, b: F.date_diff(a, b).cast("bigint"))
define("TimestampAddDays")(lambda t, n: t + F.make_dt_interval(n.cast("int")))
define("TimeAdd")(lambda t, s: t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s))
define("TimeSub")(lambda t, s: t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s))
define("Epoch")(lambda t: F.unix_micros(t.cast("timestamp")) / 1e6)
define("TimeDiffSeconds")(lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6)
define("Date", "ToDate")(lambda *a: F.make_date(*[x.cast("int") for x in a]) if len(a) == 3 else a[0].cast("date"))
define("Datetime")(lambda *a: F.call_function("make_timestamp_ntz", *[x.cast("int") for x in a]) if len(a) == 6 else a[0].cast("timestamp_ntz"))


#: Units of time and what one is in microseconds.
MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 1_000_000, "MINUTE": 60_000_000, "HOUR": 3_600_000_000, "DAY": 86_400_000_000, "WEEK": 604_800_000_000}


def _between(a: Column, b: Column, unit: str) -> Column:
    unit = unit.upper()
    if unit in MICROS:
        return F.try_divide(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")), F.lit(MICROS[unit])).cast("bigint")
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    return {"MONTH": months, "QUARTER": F.floor(months / 3), "YEAR": F.year(a) - F.year(b)}[unit].cast("bigint")


#: Days of the week in the order of ISO.
WEEKDAYS = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def _week_begin(unit: str) -> int | None:
    """Days from Monday to the day on which a unit of weeks begins; None for other units."""
    unit = unit.upper()
    if unit in ("WEEK", "ISOWEEK"):
        return 6 if unit == "WEEK" else 0
    day = re.fullmatch(r"WEEK\((\w+)\)", unit)
    if not day:
        return None
    if day[1] not in WEEKDAYS:
        raise ProgramError(f"{unit}: no such day")
    return WEEKDAYS.index(day[1])


def _truncated(t: Column, unit: str) -> Column:
    """The begin of a unit, as a timestamp."""
    late = _week_begin(unit)
    if late is None:
        return F.date_trunc(unit, t)
    days = F.make_dt_interval(F.lit(late))
    return F.date_trunc("WEEK", t.cast("timestamp_ntz") - days) + days


def _boundaries(a: Column, b: Column, unit: str) -> Column:
    """How many units begin between two days or times."""
    if unit.upper() in ("MONTH", "YEAR"):
        return _between(a, b, unit)
    if unit.upper() == "QUARTER":
        return ((F.year(a) - F.year(b)) * 4 + F.quarter(a) - F.quarter(b)).cast("bigint")
    size = "WEEK" if _week_begin(unit) is not None else unit
    return _between(_truncated(a.cast("timestamp_ntz"), unit), _truncated(b.cast("timestamp_ntz"), unit), size)


@define("DateDiff", "DatetimeDiff", literals=True)
def date_diff(a: Column, b: Column, unit: Column, literals: list) -> Column:
    """``(a, b, "UNIT")`` is a less b, ``("UNIT", a, b)`` is b less a; boundaries are counted."""
    if isinstance(literals[0], str):
        return _boundaries(unit, b, literals[0])
    return _boundaries(a, b, str(literals[2]))


@define("TimestampDiff", literals=True)
def timestamp_diff(a: Column, b: Column, unit: Column, literals: list) -> Column:
    """As ``date_diff``, but whole units are counted."""
    if isinstance(literals[0], str):
        return _between(unit, b, literals[0])
    return _between(a, b, str(literals[2]))


define("DateTrunc", literals=True)(lambda d, unit, literals: (_truncated(d, literals[1]) if isinstance(literals[1], str) else _truncated(unit, str(literals[0]))).cast("date"))
define("DatetimeTrunc", "TimestampTrunc", literals=True)(lambda t, unit, *_, literals: _truncated(t, str(literals[1])))
define("DatetimeAdd", "TimestampAdd")(lambda t, s: t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s))
define("DatetimeSub", "TimestampSub")(lambda t, s: t - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s))

#: Strftime directives and their patterns in Java.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%e": "d", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%Z": "z", "%z": "Z"}


def java_pattern(text: str) -> str:
    out = []
    for part in re.findall(r"%.|[^%]+", text):
        if part[0] == "%" and part != "%%" and part not in STRFTIME:
            raise ProgramError(f"unknown directive {part} in {text!r}")
        out.append(STRFTIME.get(part) or ("'%'" if part == "%%" else re.sub(r"[A-Za-z]+", lambda m: f"'{m.group()}'", part)))
    return "".join(out)


define("FormatDate", "FormatDatetime", "FormatTime", literals=True)(lambda p, d, literals: F.date_format(d, java_pattern(literals[0])))
define("FormatTimestamp", literals=True)(lambda p, t, zone=None, *, literals: F.date_format(t if zone is None else F.from_utc_timestamp(t, zone), java_pattern(literals[0])))
define("ParseDate", literals=True)(lambda p, s, literals: F.to_date(s, java_pattern(literals[0])))
define("ParseDatetime", literals=True)(lambda p, s, literals: F.to_timestamp_ntz(s, F.lit(java_pattern(literals[0]))))
define("ParseTimestamp", literals=True)(lambda p, s, zone=None, *, literals: F.to_timestamp(s, java_pattern(literals[0])))
define("ParseTime", literals=True)(lambda p, s, literals: F.call_function("to_time", s, F.lit(java_pattern(literals[0]))))
define("Time")(lambda h, m=None, s=None: F.call_function("make_time", h.cast("int"), m.cast("int"), s.cast("decimal(16,6)")))
define("TimeDiff", literals=True)(lambda a, b, unit, literals: F.call_function("time_diff", unit, b, a))
define("TimeTrunc", literals=True)(lambda t, unit, literals: F.call_function("time_trunc", unit, t))


def _python(name: str, body: Callable, kind: str) -> None:
    """Functions that only Python has: Arrow-batched, never row by row over the wire."""

    def of(*a: Column) -> Column:
        import pandas as pd
        from pyspark.sql.pandas.functions import PandasUDFType

        def run(*columns):
            return pd.Series([None if any(v is None for v in row) else body(*row) for row in zip(*columns, strict=True)], dtype=object)

        return F.pandas_udf(run, kind, PandasUDFType.SCALAR)(*a)

    TABLE[name] = of


def _install_python() -> None:
    import base64
    import ipaddress
    import unicodedata

    def packed(text):
        return ipaddress.ip_address(text).packed

    def safe(text):
        try:
            return packed(text)
        except ValueError:
            return None

    def masked(ip, n):
        whole = len(ip) * 8
        return (int.from_bytes(ip, "big") >> (whole - n) << (whole - n)).to_bytes(len(ip), "big")

    _python("ToBase32", lambda b: base64.b32encode(bytes(b)).decode(), "string")
    _python("FromBase32", lambda s: base64.b32decode(s), "binary")
    _python("Normalize", lambda s, form="NFC": unicodedata.normalize(form, s), "string")
    _python("NormalizeAndCasefold", lambda s, form="NFC": unicodedata.normalize(form, unicodedata.normalize(form, s).casefold()), "string")
    _python("NetIpFromString", packed, "binary")
    _python("NetSafeIpFromString", safe, "binary")
    _python("NetIpToString", lambda b: str(ipaddress.ip_address(bytes(b))), "string")
    _python("NetIpTrunc", lambda b, n: masked(bytes(b), int(n)), "binary")
    _python("NetIpNetMask", lambda size, n: masked(b"\xff" * int(size), int(n)), "binary")
    _python("NetIpInNet", lambda ip, net: ipaddress.ip_address(ip) in ipaddress.ip_network(net, strict=False), "boolean")
    _python("NetMakeNet", lambda ip, n: str(ipaddress.ip_network(f"{ip}/{int(n)}", strict=False)), "string")
    _python("NetParseIp", lambda s: int(ipaddress.ip_address(s)) if ":" not in s else None, "bigint")
    _python("NetFormatIp", lambda n: str(ipaddress.ip_address(int(n))), "string")
    _python("NetParsePackedIp", packed, "binary")
    _python("NetFormatPackedIp", lambda b: str(ipaddress.ip_address(bytes(b))), "string")


_install_python()


def known(name: str, spark=None) -> bool:
    if name in TABLE or name in WINDOWS or name in RENAMED or name in ("SqlExpr", "FlagValue", "TypeRepr"):
        return True
    return bool(name[:1].isupper() and spark is not None and spark.catalog.functionExists(snake(name)))


def call(name: str, columns: list[Column], literals: list) -> Column:
    f = TABLE.get(name)
    try:
        if f is None:
            return F.call_function(spark_name(name), *columns)
        if name in WITH_LITERALS:
            return f(*columns, literals=literals)
        return f(*columns)
    except TypeError as error:
        raise ProgramError(f"{name}: wrong number of arguments ({len(columns)})") from error
