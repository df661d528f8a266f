"""JSON, cast, string and time functions as Column expressions and driver helpers."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INT_RANGES = {"u32": (0, 2**32 - 1), "i32": (-(2**31), 2**31 - 1), "u64": (0, 2**64 - 1), "i64": (-(2**63), 2**63 - 1)}


def cast_value(c: Column, kind: str) -> Column:
    """A JSON scalar (as text; null for JSON null) as u64, u32, i64, i32, f64, f32, string or bool.

    Text is trimmed; booleans count as 1 and 0 for numbers; numbers out of range and bad text are null. Null becomes
    the text ``null`` and the boolean false.  u64 is a decimal(20,0), other integers are bigint.
    """
    t = F.trim(c)
    low = F.lower(t)
    if kind == "string":
        return F.coalesce(c, F.lit("null"))
    if kind == "bool":
        return F.when(c.isNull(), False).when(low.isin("true", "1", "on", "yes"), True).when(low.isin("false", "0", "off", "no"), False)
    number = F.when(low == "true", F.lit("1")).when(low == "false", F.lit("0")).otherwise(t)
    if kind in ("f64", "f32"):
        return number.try_cast("double" if kind == "f64" else "float")
    lo, hi = INT_RANGES[kind]
    whole = number.try_cast("decimal(38,0)")
    exact = number.rlike(r"^[+-]?\d+(\.0*)?$")
    inside = exact & whole.between(F.lit(str(lo)).cast("decimal(38,0)"), F.lit(str(hi)).cast("decimal(38,0)"))
    return F.when(inside, whole.cast("decimal(20,0)" if kind == "u64" else "bigint"))


def parse_path(path: str) -> list[str]:
    """Steps of ``.a.b[0][]^``: names, indexes, ``[]`` (iterate) and ``^`` (parent)."""
    steps = re.findall(r"\.([A-Za-z_][\w-]*)|\[(\d*)\]|(\^)", path)
    if "".join(f".{n}" if n else "^" if up else f"[{i}]" for n, i, up in steps) != path:
        raise ValueError(f"bad path {path!r}")
    return [n or ("^" if up else f"[{i}]") for n, i, up in steps]


def json_path(c: Column, path: str) -> Column:
    """All matches of a path, as an array of JSON texts (empty without a match).

    ``[]`` iterates arrays and the values of objects; an index on an object falls back to the key of that name.
    """
    none = F.array().cast("array<string>")
    stack: list[Column] = [F.when(c.isNotNull(), F.array(c)).otherwise(none)]
    for step in parse_path(path):
        if step == "^":
            stack.pop()
        elif step == "[]":
            stack.append(F.flatten(F.transform(stack[-1], lambda x: F.coalesce(_items(x), none))))
        else:
            stack.append(F.filter(F.transform(stack[-1], _child(step)), lambda x: x.isNotNull()))
    return stack[-1]


def _items(x: Column) -> Column:
    """Elements of an array or values of an object, null for a scalar."""
    listed, mapped = F.from_json(x, "array<string>"), F.map_values(F.from_json(x, "map<string,string>"))
    return F.when(F.ltrim(x).startswith("["), listed).otherwise(mapped)


def _child(step: str) -> Callable[[Column], Column]:
    if step.startswith("["):
        i = int(step[1:-1])
        return lambda x: F.coalesce(F.get_json_object(x, f"$[{i}]"), F.get_json_object(x, f"$['{i}']"))
    return lambda x: F.get_json_object(x, f"$['{step}']")


def json_select(c: Column, keys: list[str]) -> Column:
    """The object with the listed keys only, values as they are; a key that is missing or null is left out."""
    whole = F.try_parse_json(c)
    return F.to_json(F.struct(*[F.try_variant_get(whole, f"$['{k}']", "variant").alias(k) for k in keys]))


def json_bindings(bindings: dict[str, Column]) -> Column:
    """One JSON object of named expressions."""
    return F.to_json(F.struct(*[e.alias(n) for n, e in bindings.items()]))


BINDING_FUNCTIONS = {
    "now": lambda: F.unix_seconds(F.current_timestamp()), "ts": lambda: F.col("ts"), "interval": lambda secs: F.lit(secs), "attr": lambda labels, key: labels[key],
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": F.try_divide,
    "add_secs": lambda ts, s: ts + s, "sub_secs": lambda ts, s: ts - s,
    "int": lambda a: a.try_cast("bigint"), "float": lambda a: a.try_cast("double"), "str": lambda a: a.cast("string"),
}


def json_project(df: DataFrame, source: str, transforms: dict[str, tuple[str, str]], constants: dict[str, object] | None = None) -> DataFrame:
    """Columns by path and cast (first match); rows that lack one are dropped; constants come last and override."""
    d = df
    for name, (path, kind) in transforms.items():
        matches = json_path(F.col(source), path)
        d = d.withColumn(name, F.when(F.size(matches) > 0, cast_value(F.element_at(F.slice(matches, 1, 1), 1), kind)))
    for name in transforms:
        d = d.where(F.col(name).isNotNull())
    return d.withColumns({n: F.lit(v) for n, v in (constants or {}).items()})


def placeholder_names(c: Column) -> Column:
    """Distinct names of ``{{name}}`` placeholders."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{\{\s*([^{}\s]+)\s*\}\}"), F.lit(1)))


def render_template(template: str, values: dict[str, Column]) -> tuple[Column, Column]:
    """The filled template and an error text (null if all is well)."""
    names = re.findall(r"\{\{\s*([^{}]*?)\s*\}\}", template)
    rest = re.sub(r"\{\{[^{}]*\}\}", "", template)
    problem = "unterminated placeholder" if "{{" in rest else "empty placeholder" if "" in names else None
    unknown = [n for n in names if n and n not in values]
    problem = problem or (f"unknown placeholder {unknown[0]}" if unknown else None)
    if problem:
        return F.lit(None).cast("string"), F.lit(problem)
    parts, at = [], 0
    for m in re.finditer(r"\{\{\s*([^{}]*?)\s*\}\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:])), F.lit(None).cast("string")


def sanitize_metric_name(c: Column, prefix: str = "") -> Column:
    """A legal metric name: illegal letters become ``_``, leading digits one ``_``; empty becomes ``metric``."""
    legal = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_:]", "_"), "^[0-9]+", "_")
    return F.concat(F.lit(prefix), F.when(legal == "", "metric").otherwise(legal))


def escape_label_value(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def series_key(name: Column, labels: Column) -> Column:
    """name,k=v,... with sorted keys."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.concat(F.array(name), pairs), ",")


def label_float(labels: Column, key: str) -> Column:
    return F.coalesce(labels[key].try_cast("double"), F.lit(0.0))


def label_int(labels: Column, key: str) -> Column:
    return F.coalesce(labels[key].try_cast("bigint"), F.lit(0).cast("bigint"))


def json_pointer_value(c: Column, pointer: str) -> Column:
    """The JSON text at a pointer (``/a/0/b``), null if there is none."""
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return F.get_json_object(c, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps))


def json_pointer_patch(c: Column, pointer: str, value: Column) -> tuple[Column, Column]:
    """The JSON text with the value (JSON text) at a pointer, keys in order, and an error text (null if all is well).

    The last step may be new; a parent that isn't there, or is no object, is an error.
    """
    if not pointer.startswith("/") or pointer == "/":
        raise ValueError(f"{pointer!r} is no pointer: it must begin with '/' and name a field")
    steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]

    def fields(x: Column) -> Column:
        return x.try_cast("map<string,variant>")

    def put(x: Column, left: list[str]) -> Column:
        have = fields(x)
        new = F.try_parse_json(value) if len(left) == 1 else put(have[left[0]], left[1:])
        merged = F.map_concat(F.map_filter(have, lambda k, _: k != left[0]), F.create_map(F.lit(left[0]), new))
        names = F.array_sort(F.map_keys(merged))
        return F.to_variant_object(F.map_from_arrays(names, F.transform(names, lambda k: merged[k])))

    root, problem = F.try_parse_json(c), F.lit(None).cast("string")
    at, seen = root, F.lit(None).cast("string")
    for i, step in enumerate(steps):
        seen = F.coalesce(seen, F.when(fields(at).isNull(), F.lit(f"{pointer}: no object to hold {step}")))
        if i < len(steps) - 1:
            seen = F.coalesce(seen, F.when(~F.coalesce(F.map_contains_key(fields(at), step), F.lit(False)), F.lit(f"{pointer}: there is no {step}")))
            at = fields(at)[step]
    problem = F.coalesce(seen, F.when(F.try_parse_json(value).isNull(), F.lit(f"{pointer}: the value is no JSON")))
    return F.when(problem.isNull(), F.to_json(put(root, steps))), problem


def config_edit(df: DataFrame, node: str, config: str, pointer: str, value: Column, ts: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with the patched ``config`` (unchanged where ``problem`` says why), and an audit observation of each change, from and to."""
    new, problem = json_pointer_patch(F.col(config), pointer, value)
    d = df.withColumns({"__new": new, "problem": problem})
    old = F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(config), "$" + "".join(f"['{p}']" for p in pointer[1:].split("/")), "variant")), F.lit("null"))
    labels = F.create_map(F.lit("kind"), F.lit("config_edit"), F.lit("node"), F.col(node).cast("string"), F.lit("path"), F.lit(pointer), F.lit("from"), old, F.lit("to"), value)
    audit = d.where("problem IS NULL").select(
        ts.cast("bigint").alias("ts"), F.lit("config_edit").alias("metric_id"), F.lit("metric").alias("kind"), F.lit("summary").alias("signal"), F.lit(1.0).alias("value"), labels.alias("labels"),
        F.lit(None).cast("string").alias("severity"),
    )
    return d.withColumn(config, F.coalesce("__new", config)).drop("__new"), audit


def config_edits(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, field, old, new) rows where two snapshots (key, config map) differ."""
    a = old.select(key, F.explode("config").alias("field", "old"))
    b = new.select(key, F.explode("config").alias("field", "new"))
    return a.join(b, [key, "field"], "full").where(~F.col("old").eqNullSafe(F.col("new")))


UNITS = {"w": 604_800, "d": 86_400, "h": 3600, "m": 60, "s": 1}


def parse_duration(text: str, *, allow_zero: bool = False) -> int:
    """Seconds of ``1w2d3h4m5s`` (units in that order)."""
    m = re.fullmatch(r"(?:(\d+)w)?(?:(\d+)d)?(?:(\d+)h)?(?:(\d+)m)?(?:(\d+)s)?", text.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"bad duration {text!r}")
    secs = sum(int(n or 0) * u for n, u in zip(m.groups(), UNITS.values(), strict=True))
    if not secs and not allow_zero:
        raise ValueError("a duration must not be zero")
    return secs


def duration_secs(c: Column) -> Column:
    """The column form; null where the text is no duration."""
    ok = c.rlike(r"^(?=.)(\d+w)?(\d+d)?(\d+h)?(\d+m)?(\d+s)?$")
    total = sum((F.coalesce(F.regexp_extract(c, rf"(\d+){u}", 1).try_cast("bigint"), F.lit(0)) * s for u, s in UNITS.items()), F.lit(0))
    return F.when(ok, total.cast("bigint"))


def time_secs(c: Column, now: Column) -> Column:
    """The column form of ``parse_time``; null where the text is no time."""
    t = F.trim(c)
    shift = duration_secs(F.trim(F.regexp_extract(t, r"^now\s*[+-]\s*(.+)$", 1)))
    ago = duration_secs(F.regexp_extract(t, r"^((?:\d+[wdhms])+)(?:\s+ago)?$", 1))
    return (
        F.when(t == "now", now).when(t.rlike(r"^now\s*\+"), now + shift).when(t.rlike(r"^now\s*-"), now - shift)
        .when(t.rlike(r"^\d+(\.\d+)?$"), F.floor(t.try_cast("double"))).when(t.rlike(r"^(\d+[wdhms])+(\s+ago)?$"), now - ago)
        .otherwise(F.unix_seconds(F.try_to_timestamp(t))).cast("bigint")
    )


def range_start(preset: str, now: Column) -> tuple[Column, Column]:
    """The column form of ``time_range`` (UTC sessions): start and end of a preset at each row's ``now``."""
    stamp = F.timestamp_seconds(now)

    def begin(unit: str, back: int = 0) -> Column:
        start = F.date_trunc(unit, stamp)
        if back:
            start = F.date_trunc(unit, start - F.expr("INTERVAL 1 HOUR"))
        return F.unix_seconds(start)

    table = {
        "today": (begin("day"), now), "yesterday": (begin("day", 1), begin("day")), "this_week": (begin("week"), now), "last_week": (begin("week", 1), begin("week")),
        "this_month": (begin("month"), now), "last_month": (begin("month", 1), begin("month")),
    }
    if preset in table:
        return table[preset]
    return now - parse_duration(preset.removesuffix("_ago")), now


def parse_time(text: str, now: int) -> int:
    """Unix seconds of ``now``, ``now-1d``, ``now+2h``, ``2h`` (ago), ``1h ago``, a number or ISO-8601 (UTC)."""
    t = text.strip()
    if t == "now":
        return now
    if m := re.fullmatch(r"now\s*([+-])\s*(.+)", t):
        return now + (1 if m[1] == "+" else -1) * parse_duration(m[2], allow_zero=True)
    if re.fullmatch(r"\d+(\.\d+)?", t):
        return int(float(t))
    if m := re.fullmatch(r"((?:\d+[wdhms])+)(?:\s+ago)?", t):
        return now - parse_duration(m[1])
    stamp = dt.datetime.fromisoformat(t.replace("Z", "+00:00"))
    return int((stamp if stamp.tzinfo else stamp.replace(tzinfo=dt.UTC)).timestamp())


def time_range(preset: str, now: int) -> tuple[int, int]:
    """(from, to) of ``2h``, ``2h_ago``, today, yesterday, this_week, last_week (Monday), this_month, last_month; UTC."""
    day = dt.datetime.fromtimestamp(now, dt.UTC).replace(hour=0, minute=0, second=0, microsecond=0)
    week, month = day - dt.timedelta(days=day.weekday()), day.replace(day=1)
    before = (month - dt.timedelta(days=1)).replace(day=1)
    s = lambda x: int(x.timestamp())
    table = {
        "today": (s(day), now), "yesterday": (s(day) - 86_400, s(day)), "this_week": (s(week), now),
        "last_week": (s(week) - 604_800, s(week)), "this_month": (s(month), now), "last_month": (s(before), s(month)),
    }
    if preset in table:
        return table[preset]
    return now - parse_duration(preset.removesuffix("_ago")), now


def format_ts(c: Column) -> Column:
    """UTC text of unix seconds (the session's time zone is UTC)."""
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")


def ts_to_iso(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_to_ts(c: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(c))
