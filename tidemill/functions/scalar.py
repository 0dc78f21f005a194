"""The dialect's scalar functions as Spark SQL text, so that all of them run inside code generation.

Each takes the lowered arguments as (text, kind) pairs and gives such a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from tidemill.errors import SqlError

Typed = tuple[str, str]
#: Any Unicode white space, at either end.
_WS = r"(?U)\\s+"
_TS = "yyyy-MM-dd HH:mm:ss"


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\0", "\\0") + "'"


def as_text(a: Typed) -> str:
    text, kind = a
    if kind == "text":
        return text
    if kind == "bool":
        return f"cast(cast({text} as int) as string)"
    if kind == "vector":
        return f"concat('[', array_join(transform({text}, x -> if(x = floor(x), cast(cast(x as bigint) as string), cast(x as string))), ','), ']')"
    if kind == "blob":
        return f"base64({text})"
    if kind == "ts":
        return f"date_format({text}, '{_TS}')"
    return f"cast({text} as string)"


def as_real(a: Typed) -> str:
    text, kind = a
    if kind == "bool":
        return f"cast(cast({text} as int) as double)"
    return text if kind == "real" else f"cast({text} as double)"


def as_int(a: Typed) -> str:
    text, kind = a
    if kind == "int":
        return text
    if kind == "bool":
        return f"cast({text} as bigint)"
    if kind == "real":
        return f"cast(round({text}) as bigint)"
    return f"coalesce(try_cast({text} as bigint), cast(round(cast({text} as double)) as bigint))"


def as_bool(a: Typed) -> str:
    text, kind = a
    if kind == "bool":
        return text
    if kind in ("int", "real"):
        return f"({text} <> 0)"
    if kind == "text":
        return f"({text} <> '' and {text} <> '0')"
    return f"cast({text} as boolean)" if kind == "null" else f"({text} is not null)"


def as_kind(a: Typed, kind: str) -> str:
    if a[1] == "null":
        return a[0]
    if kind == "text":
        return as_text(a)
    if kind == "real":
        return as_real(a)
    if kind == "int" and a[1] == "bool":
        return as_int(a)
    return a[0]


def common_kind(args: list[Typed]) -> str:
    kinds = {k for _, k in args if k != "null"}
    if not kinds:
        return "null"
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {"int", "bool"}:
        return "int"
    return "real" if kinds <= {"int", "real", "bool"} else "text"


def unified(args: list[Typed]) -> tuple[list[str], str]:
    kind = common_kind(args)
    return [as_kind(a, kind) for a in args], kind


def as_timestamp(a: Typed) -> str:
    """A point in time from epoch seconds, ISO text (whose offset is ignored), integer text or 'now'; else null."""
    text, kind = a
    if kind == "ts":
        return f"cast({text} as timestamp)"
    if kind in ("int", "real", "bool"):
        return f"timestamp_seconds({as_real(a)})"
    s = as_text(a)
    bare = f"regexp_replace(regexp_replace(trim({s}), 'T', ' '), '([.][0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?$', '')"
    # A date's own hyphens look like an offset, so only what follows a time is cut.
    cut = f"if({s} rlike '[0-9]:[0-9]', {bare}, trim({s}))"
    return f"case when lower({s}) = 'now' then current_timestamp() when {s} rlike '^-?[0-9]+$' then timestamp_seconds(try_cast({s} as bigint)) else try_cast({cut} as timestamp) end"


def _format(a: Typed, pattern: str) -> str:
    return f"date_format({as_timestamp(a)}, '{pattern}')"


_STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}


def strftime(args: list[Typed], constants: list[object]) -> Typed:
    pattern = constants[0]
    if not isinstance(pattern, str):
        raise SqlError("strftime needs a constant format")
    ts = as_timestamp(args[1]) if len(args) > 1 else "current_timestamp()"
    parts, i = [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _STRFTIME:
            parts.append(f"date_format({ts}, '{_STRFTIME[two]}')")
        elif two == "%s":
            parts.append(f"cast(unix_timestamp({ts}) as string)")
        elif two == "%w":
            parts.append(f"cast(dayofweek({ts}) - 1 as string)")
        else:
            two = "%%" if two == "%%" else two[:1] if two[:1] != "%" else two
            parts.append(quote("%" if two == "%%" else two))
        i += len(two)
    return (f"if({ts} is null, null, concat({', '.join(parts) or repr('')}))", "text")


_PARTS = {
    "year": "year({})", "month": "month({})", "day": "day({})", "hour": "hour({})", "minute": "minute({})", "second": "second({})",
    "dow": "dayofweek({}) - 1", "doy": "dayofyear({})", "quarter": "quarter({})", "epoch": "unix_timestamp({})",
}


def extract(args: list[Typed], constants: list[object]) -> Typed:
    part = str(constants[0]).lower()
    if part not in _PARTS:
        return ("cast(null as bigint)", "int")
    return (f"cast({_PARTS[part].format(as_timestamp(args[1]))} as bigint)", "int")


def date_trunc(args: list[Typed], constants: list[object]) -> Typed:
    unit = str(constants[0]).lower()
    if unit not in ("year", "quarter", "month", "week", "day", "hour", "minute", "second"):
        raise SqlError(f"unknown unit {unit!r} in date_trunc")
    return (f"date_format(date_trunc('{unit}', {as_timestamp(args[1])}), '{_TS}')", "text")


def json_literal(a: Typed) -> str:
    """A value as a JSON fragment."""
    text, kind = a
    if kind == "null":
        return "'null'"
    if kind == "text":
        quoted = f"substring(to_json(array({text})), 2, length(to_json(array({text}))) - 2)"
        return f"coalesce({quoted}, 'null')"
    if kind == "real":
        return f"coalesce(if({text} = floor({text}) and abs({text}) < 1e15D, cast(cast({text} as bigint) as string), cast({text} as string)), 'null')"
    if kind == "bool":
        return f"coalesce(cast({text} as string), 'null')"
    if kind == "vector":
        return f"coalesce({as_text(a)}, 'null')"
    return f"coalesce({as_text(a)}, 'null')" if kind == "int" else f"coalesce({json_literal((as_text(a), 'text'))}, 'null')"


def _path(key: object, typed: Typed) -> str:
    if isinstance(key, int) and not isinstance(key, bool):
        return quote(f"$[{key}]")
    if isinstance(key, str):
        return quote("$['" + key.replace("'", "\\'") + "']")
    return f"concat('$[', {as_text(typed)}, ']')" if typed[1] == "int" else f"concat('$[''', {as_text(typed)}, ''']')"


def json_get_text(j: Typed, k: Typed, key: object) -> Typed:
    """A member as text: null for a JSON null and for what isn't there; negative indices count from the end."""
    s = as_text(j)
    if isinstance(key, int) and key < 0:
        at = f"json_array_length({s}) {key}"
        return (f"if({at} < 0, null, get_json_object({s}, concat('$[', cast({at} as string), ']')))", "text")
    return (f"get_json_object({s}, {_path(key, k)})", "text")


def json_get(j: Typed, k: Typed, key: object) -> Typed:
    """A member as JSON: scalars that were strings are quoted again."""
    s = as_text(j)
    value = json_get_text(j, k, key)[0]
    if isinstance(key, int):
        index = f"cast({key} as int)" if key >= 0 else f"(json_array_length({s}) {key})"
        raw = f"get(from_json({s}, 'array<variant>'), {index})"
    else:
        raw = f"variant_get(try_parse_json({s}), {_path(key, k)}, 'variant')" if isinstance(key, str) else f"try_variant_get(try_parse_json({s}), {_path(key, k)}, 'variant')"
    kind = f"schema_of_variant({raw})"
    text = f"case when {kind} = 'STRING' then {json_literal((value, 'text'))} when {kind} = 'VOID' then 'null' else {value} end"
    return (text, "text")


def _unary_real(name: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: (f"{name}({as_real(a[0])})", "real")


def _text_to(name: str, kind: str = "text") -> Callable[[list[Typed]], Typed]:
    return lambda a: (f"{name}({as_text(a[0])})", kind)


def _log(call: str) -> Callable[[list[Typed]], Typed]:
    def out(a: list[Typed]) -> Typed:
        x = as_real(a[0])
        return (f"case when {x} > 0 then {call}({x}) when {x} = 0 then double('-Infinity') when {x} is null then null else double('NaN') end", "real")

    return out


def _unify(name: str) -> Callable[[list[Typed]], Typed]:
    def out(a: list[Typed]) -> Typed:
        texts, kind = unified(a)
        if name in ("greatest", "least") and len(texts) == 1:
            return (texts[0], kind)
        return (f"{name}({', '.join(texts)})", kind)

    return out


def _substr(a: list[Typed]) -> Typed:
    s, i = as_text(a[0]), as_int(a[1])
    if len(a) == 2:
        return (f"substring({s}, cast({i} as int))", "text")
    n = as_int(a[2])
    return (f"if({i} = 0, substring({s}, 1, cast(greatest({n} - 1, 0) as int)), substring({s}, cast({i} as int), cast(greatest({n}, 0) as int)))", "text")


def _side(name: str) -> Callable[[list[Typed]], Typed]:
    def out(a: list[Typed]) -> Typed:
        s, n = as_text(a[0]), as_int(a[1])
        return (f"{name}({s}, cast(if({n} >= 0, {n}, greatest(char_length({s}) + {n}, 0)) as int))", "text")

    return out


def _pad(name: str) -> Callable[[list[Typed]], Typed]:
    def out(a: list[Typed]) -> Typed:
        fill = as_text(a[2]) if len(a) > 2 else "' '"
        return (f"{name}({as_text(a[0])}, cast({as_int(a[1])} as int), {fill})", "text")

    return out


def _round(a: list[Typed]) -> Typed:
    if len(a) == 1:
        return (f"cast(round({as_real(a[0])}) as bigint)", "int")
    return (f"round({as_real(a[0])}, cast({as_int(a[1])} as int))", "real")


def _iif(a: list[Typed]) -> Typed:
    if len(a) != 3:
        raise SqlError("iif takes three arguments")
    texts, kind = unified(a[1:])
    return (f"if({as_bool(a[0])}, {texts[0]}, {texts[1]})", kind)


def _object(a: list[Typed]) -> Typed:
    if len(a) % 2:
        raise SqlError("json_build_object takes pairs")
    pairs = [f"concat({json_literal((as_text(k), 'text'))}, ':', {json_literal(v)})" for k, v in zip(a[::2], a[1::2], strict=True)]
    return (f"concat('{{', concat_ws(',', {', '.join(pairs)}), '}}')" if pairs else "'{}'", "text")


def _array(a: list[Typed]) -> Typed:
    return (f"concat('[', concat_ws(',', {', '.join(map(json_literal, a))}), ']')" if a else "'[]'", "text")


def _typeof(a: list[Typed]) -> Typed:
    name = {"int": "integer", "real": "real", "text": "text", "blob": "blob", "vector": "vector", "bool": "integer", "ts": "text", "null": "null"}[a[0][1]]
    return (f"if({a[0][0]} is null, 'null', '{name}')", "text")


def _trim(pattern: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: (f"regexp_replace({as_text(a[0])}, '{pattern}', '')", "text")


def _now(pattern: str) -> Callable[[list[Typed]], Typed]:
    return lambda a: (f"date_format(current_timestamp(), '{pattern}')", "text")


def _hex(a: list[Typed]) -> Typed:
    return (f"hex({a[0][0]})" if a[0][1] == "blob" else f"hex({as_text(a[0])})", "text")


FUNCTIONS: dict[str, Callable[[list[Typed]], Typed]] = {
    "coalesce": _unify("coalesce"), "greatest": _unify("greatest"), "least": _unify("least"), "ifnull": _unify("coalesce"),
    "nullif": lambda a: (f"nullif({', '.join(unified(a)[0])})", a[0][1]),
    "iif": _iif, "if": _iif,
    "lower": _text_to("lower"), "upper": _text_to("upper"), "reverse": _text_to("reverse"),
    "trim": _trim(f"{_WS[:4]}^{_WS[4:]}|{_WS[4:]}$"), "btrim": _trim(f"{_WS[:4]}^{_WS[4:]}|{_WS[4:]}$"), "ltrim": _trim(f"{_WS[:4]}^{_WS[4:]}"), "rtrim": _trim(f"{_WS[:4]}{_WS[4:]}$"),
    "length": lambda a: (f"cast(char_length({as_text(a[0])}) as bigint)", "int"),
    "concat": lambda a: (f"concat_ws('', {', '.join(map(as_text, a))})", "text"),
    "substr": _substr, "substring": _substr,
    "replace": lambda a: (f"replace({', '.join(map(as_text, a))})", "text"),
    "instr": lambda a: (f"cast(instr({as_text(a[0])}, {as_text(a[1])}) as bigint)", "int"),
    "repeat": lambda a: (f"repeat({as_text(a[0])}, cast(greatest({as_int(a[1])}, 0) as int))", "text"),
    "left": _side("left"), "right": _side("right"), "lpad": _pad("lpad"), "rpad": _pad("rpad"), "hex": _hex,
    "abs": lambda a: (f"abs({a[0][0]})", "int") if a[0][1] == "int" else (f"abs({as_real(a[0])})", "real"),
    "round": _round,
    "ceil": lambda a: (f"cast(ceil({as_real(a[0])}) as double)", "real"), "floor": lambda a: (f"cast(floor({as_real(a[0])}) as double)", "real"),
    "trunc": lambda a: (f"cast(if({as_real(a[0])} < 0, ceil({as_real(a[0])}), floor({as_real(a[0])})) as double)", "real"),
    "sqrt": _unary_real("sqrt"), "exp": _unary_real("exp"), "ln": _log("ln"), "log": _log("log10"), "log10": _log("log10"),
    "sign": lambda a: (f"cast(sign({as_real(a[0])}) as bigint)", "int"),
    "power": lambda a: (f"power({as_real(a[0])}, {as_real(a[1])})", "real"),
    "mod": lambda a: (f"try_mod({as_int(a[0])}, {as_int(a[1])})", "int"),
    "pi": lambda a: ("pi()", "real"), "random": lambda a: ("rand()", "real"),
    "now": _now(_TS), "current_date": _now("yyyy-MM-dd"), "current_time": _now("HH:mm:ss"),
    "date": lambda a: (_format(a[0], "yyyy-MM-dd"), "text"), "datetime": lambda a: (_format(a[0], _TS), "text"), "time": lambda a: (_format(a[0], "HH:mm:ss"), "text"),
    "unixepoch": lambda a: (f"unix_timestamp({as_timestamp(a[0])})", "int"),
    "json_array": _array, "json_build_object": _object,
    "to_json": lambda a: (f"if({a[0][0]} is null, 'null', {json_literal(a[0])})", "text"),
    "gen_random_uuid": lambda a: ("uuid()", "text"), "typeof": _typeof,
}
ALIASES = {
    "char_length": "length", "character_length": "length", "strpos": "instr", "ceiling": "ceil", "pow": "power", "uuid_generate_v4": "gen_random_uuid",
    "current_timestamp": "now", "transaction_timestamp": "now", "statement_timestamp": "now", "clock_timestamp": "now", "localtimestamp": "now", "localtime": "current_time",
    "json_build_array": "json_array", "jsonb_build_array": "json_array", "jsonb_build_object": "json_build_object", "to_jsonb": "to_json", "json_object": "json_build_object",
}
#: Functions whose first argument is read as a constant.
CONSTANT_FIRST = {"strftime": strftime, "extract": extract, "date_part": extract, "date_trunc": date_trunc}


def json_extract(j: Typed, path: object) -> Typed:
    """The value at a path as text, containers as JSON; booleans as 1 and 0."""
    if not isinstance(path, str):
        raise SqlError("json_extract needs a constant path")
    value = f"get_json_object({as_text(j)}, {quote(path)})"
    return (f"case {value} when 'true' then '1' when 'false' then '0' else {value} end", "text")


def call(name: str, args: list[Typed], constants: list[object]) -> Typed:
    name = ALIASES.get(name, name)
    if name in CONSTANT_FIRST:
        return CONSTANT_FIRST[name](args, constants)
    if name == "json_extract":
        return json_extract(args[0], constants[1])
    if name in ("json_get", "json_get_text"):
        return (json_get if name == "json_get" else json_get_text)(args[0], args[1], constants[1])
    if name not in FUNCTIONS:
        raise SqlError(f"unknown function {name}")
    try:
        return FUNCTIONS[name](args)
    except IndexError:
        raise SqlError(f"too few arguments for {name}") from None
