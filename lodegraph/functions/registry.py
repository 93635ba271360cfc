"""Scalar and aggregate functions by lower-case name, as builders of Columns.

Everything is a built-in expression, but for the few functions that Spark lacks (gamma, lgamma, nextafter,
strip_accents, nfc_normalize), which are Arrow-fed pandas functions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]
SCALAR: dict[str, Builder] = {}
AGGREGATE: dict[str, Builder] = {}


def scalar(*names: str):
    def put(f: Builder) -> Builder:
        SCALAR.update(dict.fromkeys(names, f))
        return f

    return put


def aggregate(*names: str):
    def put(f: Builder) -> Builder:
        AGGREGATE.update(dict.fromkeys(names, f))
        return f

    return put


def constant(x) -> object:
    """The Python value of a literal argument."""
    if hasattr(x, "_literal"):
        return x._literal
    raise ValueError("this argument must be a literal")


# -- strings
SCALAR |= dict.fromkeys(("lower", "lcase", "tolower"), F.lower) | dict.fromkeys(("upper", "ucase", "toupper"), F.upper)
SCALAR |= {"contains": F.contains, "prefix": F.startswith, "suffix": F.endswith, "strlen": lambda x: F.octet_length(x).cast("long"), "bit_length": F.bit_length, "octet_length": F.octet_length}
SCALAR |= {"ascii": F.ascii, "chr": F.chr, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "levenshtein": F.levenshtein, "editdist3": F.levenshtein, "md5": F.md5, "base64": F.base64, "uuid": F.uuid}
SCALAR |= dict.fromkeys(("unicode", "ord"), F.ascii)


@scalar("concat")
def _concat(*xs):
    return F.concat(*(F.coalesce(x.cast("string"), F.lit("")) for x in xs))


@scalar("concat_ws")
def _concat_ws(sep, *xs):
    return F.array_join(F.filter(F.array(*(x.cast("string") for x in xs)), lambda x: x.isNotNull()), constant(sep))


@scalar("length", "len")
def _length(x):
    return F.length(x).cast("long")


@scalar("size", "list_size", "array_length")
def _size(x):
    return F.when(x.isNotNull(), F.size(x)).cast("long")


@scalar("regexp_full_match")
def _full(x, p):
    return F.rlike(x, F.concat(F.lit("^(?:"), p, F.lit(")\\z")))


@scalar("regexp_matches")
def _matches(x, p):
    return F.rlike(x, p)


@scalar("regexp_replace")
def _regexp_replace(x, p, r, options=None):
    if options is not None and "g" in str(constant(options)):
        return F.regexp_replace(x, p, r)
    # the first match only: what stands before it, then the replaced match
    first = F.regexp_substr(x, p)
    at = F.instr(x, first)
    return F.when(first.isNull(), x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.regexp_replace(first, p, r), F.substring(x, at + F.length(first), F.length(x))))


@scalar("regexp_extract")
def _regexp_extract(x, p, group=None):
    return F.regexp_extract(x, constant(p), int(constant(group)) if group is not None else 0)


@scalar("substring", "substr")
def _substring(x, begin, size=None):
    return F.substring(x, (begin + 1).cast("int"), size.cast("int") if size is not None else F.length(x))


@scalar("left")
def _left(x, n):
    return F.when(n >= 0, F.left(x, n.cast("int"))).otherwise(F.left(x, F.greatest(F.length(x) + n, F.lit(0)).cast("int")))


@scalar("right")
def _right(x, n):
    return F.when(n >= 0, F.right(x, n.cast("int"))).otherwise(F.right(x, F.greatest(F.length(x) + n, F.lit(0)).cast("int")))


SCALAR |= {"lpad": lambda x, n, p: F.lpad(x, n.cast("int"), p), "rpad": lambda x, n, p: F.rpad(x, n.cast("int"), p), "repeat": lambda x, n: F.repeat(x, n.cast("int")), "replace": lambda x, a, b: F.replace(x, a, b)}
SCALAR |= dict.fromkeys(("instr", "strpos", "position"), lambda x, y: F.coalesce(F.call_function("instr", x, y), F.lit(0)).cast("long"))
SCALAR["reverse"] = F.reverse


@scalar("string_split", "str_split", "string_to_array", "split")
def _split(x, sep):
    return F.split(x, re.escape(constant(sep)), -1)


@scalar("string_split_regex", "str_split_regex", "regexp_split_to_array")
def _split_regex(x, p):
    return F.split(x, p, -1)


@scalar("printf")
def _printf(form, *xs):
    return F.format_string(constant(form), *xs)


@scalar("format")
def _format(form, *xs):
    parts = re.split(r"\{\}", constant(form))
    out = [F.lit(parts[0])]
    for p, x in zip(parts[1:], xs, strict=True):
        out += [x.cast("string"), F.lit(p)]
    return F.concat(*out)


@scalar("mismatches", "hamming")
def _hamming(x, y):
    pairs = F.zip_with(F.split(x, "", -1), F.split(y, "", -1), lambda a, b: (a != b).cast("long"))
    bad = (F.length(x) != F.length(y)) | (F.length(x) == 0)
    return F.when(bad, F.raise_error(F.lit("hamming: strings of one length above 0 are needed")).cast("long")).otherwise(F.aggregate(pairs, F.lit(0).cast("long"), lambda a, v: a + v))


@scalar("jaccard")
def _jaccard(x, y):
    a, b = F.array_distinct(F.split(x, "")), F.array_distinct(F.split(y, ""))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _like(x, p, escape=None):
    return x.like(constant(p)) if escape is None else F.like(x, p, escape)


SCALAR |= {"~~": _like, "like_escape": _like, "not_like_escape": lambda x, p, e: ~_like(x, p, e), "!~~": lambda x, p: ~_like(x, p), "~~*": lambda x, p: F.ilike(x, p), "!~~*": lambda x, p: ~F.ilike(x, p)}
SCALAR |= {"ilike_escape": lambda x, p, e: F.ilike(x, p, e), "not_ilike_escape": lambda x, p, e: ~F.ilike(x, p, e)}


@scalar("glob", "~~~")
def _glob(x, p):
    out = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in constant(p))
    return F.rlike(x, F.lit(f"(?s)^{out}\\z"))


SCALAR |= dict.fromkeys(("tostring", "string"), lambda x: x.cast("string"))
SCALAR |= dict.fromkeys(("tointeger", "toint"), lambda x: F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint")))
SCALAR["tofloat"] = lambda x: x.try_cast("double")


@scalar("toboolean")
def _toboolean(x):
    low = F.lower(F.trim(x.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


SCALAR["cast"] = lambda x, kind: x.try_cast({"integer": "int", "int64": "bigint", "varchar": "string", "float": "float"}.get(str(constant(kind)).lower(), str(constant(kind))))

# -- numbers
for _name in ("abs", "floor", "degrees", "radians", "cbrt", "exp", "log2", "log10", "ln", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "cot", "atan2", "pi", "bit_count", "isnan", "factorial"):
    SCALAR[_name] = getattr(F, _name)
SCALAR |= {"sign": F.signum, "ceil": F.ceil, "ceiling": F.ceil, "round": lambda x, n=None: F.round(x, int(constant(n)) if n is not None else 0), "pow": F.pow, "power": F.pow}
SCALAR |= {"even": lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2, "isinf": lambda x: F.abs(x) == float("inf"), "isfinite": lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")), "mod": lambda x, y: F.try_mod(x, y)}
_SEED: list[int] = []


@scalar("setseed")
def _setseed(x):
    """From here on random() gives the same numbers again; x from -1 to 1."""
    _SEED[:] = [int(float(constant(x)) * (1 << 31))]
    return F.lit(None).cast("string")


SCALAR |= dict.fromkeys(("random", "rand"), lambda: F.rand(*_SEED))
SCALAR |= {"xor": lambda x, y: x.bitwiseXOR(y), "log": F.log10}


def _pandas(f: Callable, kind: str) -> Builder:
    def build(*xs):
        import pandas as pd

        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*series, strict=True)])

        hints = {f"a{k}": pd.Series for k in range(len(xs))} | {"return": pd.Series}
        if len(xs) == 1:

            def own(a0):
                return run(a0)
        else:

            def own(a0, a1):
                return run(a0, a1)

        own.__annotations__ = hints
        return F.pandas_udf(own, kind)(*xs)

    return build


def _strip(s: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def _nfc(s: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFC", s)


SCALAR |= {"strip_accents": _pandas(_strip, "string"), "nfc_normalize": _pandas(_nfc, "string"), "gamma": _pandas(math.gamma, "double"), "lgamma": _pandas(math.lgamma, "double"), "nextafter": _pandas(math.nextafter, "double")}

# -- dates
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": lambda x: F.second(x), "quarter": F.quarter, "week": F.weekofyear, "dayofmonth": F.dayofmonth, "dayofyear": F.dayofyear, "doy": F.dayofyear}
PARTS |= {"dayofweek": lambda x: F.dayofweek(x) - 1, "dow": lambda x: F.dayofweek(x) - 1, "weekday": lambda x: F.dayofweek(x) - 1, "isodow": lambda x: F.weekday(x) + 1, "decade": lambda x: F.floor(F.year(x) / 10), "century": lambda x: F.floor((F.year(x) + 99) / 100)}
PARTS |= {"millennium": lambda x: F.floor((F.year(x) + 999) / 1000), "era": lambda x: F.when(F.year(x) > 0, 1).otherwise(0), "epoch": lambda x: F.unix_micros(x.cast("timestamp")) / 1_000_000, "yearweek": lambda x: F.extract(F.lit("yearofweek"), x) * 100 + F.weekofyear(x)}
PARTS |= {"millisecond": lambda x: F.pmod(F.floor(F.unix_micros(x.cast("timestamp")) / 1000), F.lit(60_000)), "microsecond": lambda x: F.pmod(F.unix_micros(x.cast("timestamp")), F.lit(60_000_000)), "epochmillis": lambda x: F.unix_millis(x.cast("timestamp"))}
SCALAR |= {k: (lambda f: lambda x: f(x).cast("long"))(f) for k, f in PARTS.items()}
SCALAR["epoch"] = PARTS["epoch"]


@scalar("date_part", "datepart")
def _date_part(part, x):
    return SCALAR[str(constant(part)).lower().rstrip("s") if str(constant(part)).lower() not in PARTS else str(constant(part)).lower()](x)


@scalar("date_trunc", "datetrunc")
def _date_trunc(part, x):
    part = str(constant(part)).lower()
    years = {"decade": 10, "century": 100, "millennium": 1000}.get(part)
    if years:
        shift = 0 if part == "decade" else 1
        return F.make_date(F.floor((F.year(x) - shift) / years).cast("int") * years + shift, F.lit(1), F.lit(1)).cast("timestamp")
    return F.date_trunc(part, x)


MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
MONTHS = {"month": 1, "quarter": 3, "year": 12, "decade": 120, "century": 1200, "millennium": 12000}


def _part(x) -> str:
    part = str(constant(x)).lower()
    return part if part in MICROS or part in MONTHS else part.rstrip("s")


@scalar("date_diff", "datediff")
def _date_diff(part, a, b):
    """Borders of the part crossed."""
    part = _part(part)
    if part in MONTHS:
        months = lambda x: F.year(x) * 12 + F.month(x) - 1
        return (F.floor(months(b) / MONTHS[part]) - F.floor(months(a) / MONTHS[part])).cast("long")
    if part in ("day", "week"):  # weeks are counted from the epoch's day
        size = 7 if part == "week" else 1
        days = lambda x: (F.unix_date(F.to_date(x)) / size).cast("long")
        return days(b) - days(a)
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return (F.floor(micros(b) / MICROS[part]) - F.floor(micros(a) / MICROS[part])).cast("long")


@scalar("date_sub", "datesub")
def _date_sub(part, a, b):
    """Whole units between."""
    part = _part(part)
    if part in MONTHS:
        whole = F.floor(F.abs(F.months_between(b, a, roundOff=False)))
        return (F.signum(F.months_between(b, a)) * F.floor(whole / MONTHS[part])).cast("long")
    d = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return (F.signum(d) * F.floor(F.abs(d) / MICROS[part])).cast("long")


SCALAR |= {"make_date": lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int")), "make_time": lambda h, m, s: ((h.cast("long") * 3600 + m * 60) * 1_000_000 + s * 1_000_000).cast("long")}
SCALAR |= {"make_timestamp": lambda y, mo, d, h, mi, s: F.make_timestamp(y.cast("int"), mo.cast("int"), d.cast("int"), h.cast("int"), mi.cast("int"), s), "epoch_ms": lambda x: F.timestamp_millis(x.cast("long")), "to_timestamp": lambda x: F.timestamp_seconds(x)}
SCALAR |= {"timestamp": lambda: F.unix_millis(F.current_timestamp()), "current_date": F.current_date, "now": F.current_timestamp, "current_time": lambda: F.date_format(F.current_timestamp(), "HH:mm:ss")}
SCALAR |= {f"to_{n}": (lambda k: lambda x: F.make_interval(**{k: x.cast("int") if k != "secs" else x}))(k) for n, k in (("years", "years"), ("months", "months"), ("days", "days"), ("hours", "hours"), ("minutes", "mins"), ("seconds", "secs"))}
SCALAR |= {"to_milliseconds": lambda x: F.make_interval(secs=x / 1000), "to_microseconds": lambda x: F.make_interval(secs=x / 1_000_000)}
# Strftime letters and Spark's patterns.
PATTERN = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "g": "SSS", "y": "yy", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "I": "hh", "%": "%"}


def pattern(text: str) -> str:
    out = re.sub(r"%-?([A-Za-z%])|([A-Za-z]+)", lambda m: PATTERN[m[1]] if m[1] else f"'{m[2]}'", text)
    return out


SCALAR["strftime"] = lambda x, form: F.date_format(x, pattern(constant(form)))
SCALAR["strptime"] = lambda x, form: F.to_timestamp(x, pattern(constant(form)))


@scalar("age")
def _age(a, b=None):
    """struct(months, days, micros) between."""
    a, b = (a, b) if b is not None else (F.current_date().cast("timestamp"), a)
    a, b, sign = F.greatest(a, b).cast("timestamp"), F.least(a, b).cast("timestamp"), F.when(a < b, -1).otherwise(1)
    clock = lambda x: F.pmod(F.unix_micros(x), F.lit(MICROS["day"]))
    short = F.dayofmonth(a) * F.lit(MICROS["day"]) + clock(a) < F.dayofmonth(b) * F.lit(MICROS["day"]) + clock(b)
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b) - short.cast("int")
    rest = F.unix_micros(a) - F.unix_micros(F.add_months(b, months).cast("timestamp")) - clock(b)
    return F.struct((sign * months).alias("months"), (sign * F.floor(rest / MICROS["day"])).cast("int").alias("days"), (sign * F.pmod(rest, F.lit(MICROS["day"]))).alias("micros"))


SCALAR["date"] = lambda x=None: F.current_date() if x is None else F.to_date(x)
SCALAR["datetime"] = lambda x=None: F.current_timestamp() if x is None else F.to_timestamp(x)

# -- lists, maps, values
SCALAR |= dict.fromkeys(("list_value", "list_pack", "list_creation"), lambda *xs: F.array(*xs))
SCALAR |= {"coalesce": F.coalesce, "nullif": F.nullif, "ifnull": F.coalesce, "flatten": F.flatten, "cardinality": lambda x: F.size(x).cast("long"), "map_extract": F.element_at}


def list_extract(x, i):
    return F.get(x, F.when(i < 0, F.size(x) + i).otherwise(i).cast("int"))


def list_slice(x, a, b):
    n = F.size(x)
    at = lambda v: F.greatest(F.lit(0), F.least(n, F.when(v < 0, n + v).otherwise(v))).cast("int")
    a, b = at(a) if a is not None else F.lit(0), at(b) if b is not None else n
    return F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))


SCALAR |= dict.fromkeys(("list_extract", "list_element", "array_extract"), list_extract) | dict.fromkeys(("array_slice", "list_slice"), list_slice)
SCALAR |= dict.fromkeys(("list_contains", "array_contains", "list_has", "array_has"), lambda x, v: F.array_contains(x, v))
SCALAR |= dict.fromkeys(("list_position", "list_indexof", "array_position", "array_indexof"), lambda x, v: F.array_position(x, v))
SCALAR |= dict.fromkeys(("list_concat", "list_cat", "array_concat"), F.concat)
SCALAR |= {"head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.element_at(F.when(F.size(x) > 0, x), -1), "tail": lambda x: F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))}


@scalar("range")
def _range(a, b=None, step=None):
    if b is None:
        a, b = F.lit(0), a
    step = F.lit(1) if step is None else step
    a, b, step = (x.cast("long") for x in (a, b, step))
    empty = F.array().cast("array<bigint>")
    return F.when(step == 0, F.raise_error(F.lit("range: the step is 0")).cast("array<bigint>")).when(((step > 0) & (a <= b)) | ((step < 0) & (a >= b)), F.sequence(a, b, step)).otherwise(empty)


@scalar("list_sum")
def _list_sum(x):
    return F.aggregate(F.filter(x, lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v.try_cast("double"))


@scalar("list_aggregate", "list_aggr", "array_aggregate")
def _list_aggregate(x, name):
    """An aggregate of a list's elements, nulls left out: count, sum, avg, min, max, first, last, or string_agg."""
    own = F.filter(x, lambda v: v.isNotNull())
    n = F.size(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v.cast("double"))
    kinds = {
        "count": n.cast("long"), "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n), "min": F.array_min(own), "max": F.array_max(own),
        "first": F.get(own, F.lit(0)), "last": F.get(own, n - 1), "string_agg": F.when(n > 0, F.array_join(own.cast("array<string>"), ",")),
    }
    return kinds[str(constant(name)).lower()]


SCALAR["struct_extract"] = lambda x, name: x.getField(str(constant(name)))
SCALAR |= dict.fromkeys(("list_min",), F.array_min) | dict.fromkeys(("list_max",), F.array_max) | {"list_distinct": F.array_distinct, "list_sort": F.array_sort}

# -- aggregates
AGGREGATE |= {"count": F.count, "min": F.min, "max": F.max, "first": F.first, "arbitrary": F.any_value, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor, "bool_and": F.bool_and, "bool_or": F.bool_or, "product": F.product}
AGGREGATE |= {"covar_pop": F.covar_pop, "covar_samp": F.covar_samp, "corr": F.corr, "stddev": F.stddev_samp, "stddev_samp": F.stddev_samp, "stddev_pop": F.stddev_pop, "stdev": F.stddev_samp, "stdevp": F.stddev_pop, "variance": F.var_samp, "var_samp": F.var_samp, "var_pop": F.var_pop}
for _name in ("regr_avgx", "regr_avgy", "regr_count", "regr_slope", "regr_intercept", "regr_r2", "regr_sxx", "regr_syy", "regr_sxy"):
    AGGREGATE[_name] = getattr(F, _name)
AGGREGATE["last"] = F.last
SCALAR["list_last"] = SCALAR.pop("last")
AGGREGATE |= {"approx_count_distinct": F.approx_count_distinct, "mode": F.mode, "median": F.median}
AGGREGATE["approx_quantile"] = lambda x, q: F.percentile_approx(x, constant(q))
AGGREGATE |= dict.fromkeys(("percentilecont", "quantile_cont"), lambda x, q: F.percentile(x, constant(q))) | dict.fromkeys(("percentiledisc", "reservoir_quantile", "quantile"), lambda x, q: F.percentile_approx(x, constant(q), 1_000_000))
AGGREGATE |= dict.fromkeys(("argmin", "min_by", "arg_min"), F.min_by) | dict.fromkeys(("argmax", "max_by", "arg_max"), F.max_by)
AGGREGATE |= dict.fromkeys(("string_agg", "group_concat"), lambda x, sep=None: F.listagg(x.cast("string"), sep if sep is not None else F.lit(",")))
AGGREGATE |= {"avg": lambda x: F.avg(x.cast("double")), "mean": lambda x: F.avg(x.cast("double")), "sum": F.sum, "collect": F.collect_list}
AGGREGATE |= dict.fromkeys(("list", "array_agg"), lambda x: F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"]))
AGGREGATE["sem"] = lambda x: F.stddev_pop(x) / F.sqrt(F.count(x))
AGGREGATE["histogram"] = lambda x: F.aggregate(F.collect_list(x), F.create_map().cast("map<string,bigint>"), lambda m, v: F.map_concat(F.map_filter(m, lambda k, c: k != v.cast("string")), F.create_map(v.cast("string"), F.coalesce(F.element_at(m, v.cast("string")), F.lit(0)) + 1)))


@aggregate("fsum", "kahan_sum", "sumkahan")
def _fsum(x):
    """Each value goes in parts of 26 bits at fixed places, which add up without rounding (below 2**50, to some 10**8 rows); the last few sums are rounded."""
    x = x.cast("double")
    small = F.abs(x) < 2.0**900  # the others, infinity and NaN as well, are added as they are
    steps = [F.rint(x * 2.0**-k) * 2.0**k for k in (24, -2, -28, -54)]
    parts = [F.when(small, steps[0]).otherwise(x)] + [F.when(small, b - a).otherwise(0.0) for a, b in zip(steps, [*steps[1:], x], strict=True)]
    return reduce(lambda a, b: a + b, [F.sum(y) for y in reversed(parts)])


AGGREGATE["favg"] = lambda x: F.when(F.count(x) > 0, _fsum(x) / F.count(x))


@aggregate("skewness")
def _skewness(x):
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


@aggregate("kurtosis")
def _kurtosis(x):
    n = F.count(x).cast("double")
    return F.when(n > 3, ((n + 1) * (F.kurtosis(x) + 3) - 3 * (n - 1)) * (n - 1) / ((n - 2) * (n - 3)))


@aggregate("entropy")
def _entropy(x):
    """In bits, of the values' shares: from the sorted list of values, in the group."""
    values = F.array_sort(F.collect_list(x))
    step = lambda s, v: F.struct(
        F.when(v == s["v"], s["c"] + 1.0).otherwise(F.lit(1.0)).alias("c"),
        F.when((v == s["v"]) | s["v"].isNull(), s["t"]).otherwise(s["t"] + s["c"] * F.log2(s["c"])).alias("t"),
        v.cast("string").alias("v"),
    )
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("t"), F.lit(None).cast("string").alias("v"))
    total = F.aggregate(F.transform(values, lambda v: v.cast("string")), start, step, lambda s: s["t"] + F.when(s["c"] > 0, s["c"] * F.log2(s["c"])).otherwise(0.0))
    n = F.count(x).cast("double")
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))
