"""The engine's SQL dialect, translated token by token into Spark SQL.

A statement is cut into tokens, so nothing inside a literal, a quoted name or a
comment is ever touched.  Calls are rewritten with their arguments, which are
translated first; the clauses after a call (FILTER, OVER, WITHIN GROUP) go with
it.  What needs types, whole-number division, is left to ``sqlfront``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<string>[eE]?'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  | (?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
  | (?P<param>\$\d+|\?)
  | (?P<word>[^\W\d]\w*)
  | (?P<op>::|!~\*|!~|~\*|<=>|<=|>=|<>|!=|\|\||->>|->|=>|<<|>>|.)""",
    re.VERBOSE | re.DOTALL,
)

#: Names of other dialects and what Spark calls the same; arguments stay.
RENAMED = {
    "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros", "from_unixtime": "timestamp_seconds",
    "approx_distinct": "approx_count_distinct", "array_concat": "concat", "array_cat": "concat", "array_has": "array_contains", "list_contains": "array_contains", "array_contains": "array_contains",
    "array_has_any": "arrays_overlap", "make_array": "array", "arrow_typeof": "typeof", "substr_index": "substring_index", "mean": "avg", "var": "var_samp", "var_sample": "var_samp", "covar": "covar_samp",
    "random": "rand", "strpos": "instr", "starts_with": "startswith", "ends_with": "endswith", "array_reverse": "reverse", "make_map": "map", "array_element": "try_element_at",
    "array_extract": "try_element_at", "generate_series": "sequence", "unnest": "explode", "pow": "power", "date_format": "to_char", "string_agg": "string_agg", "datepart": "date_part", "datetrunc": "date_trunc", "row": "struct",
}

#: fixed values: type names of the dialect and of its column format.
TYPES = {
    "varchar": "string", "text": "string", "char": "string", "utf8": "string", "largeutf8": "string", "utf8view": "string", "int1": "tinyint", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "float4": "float", "float8": "double", "real": "float", "bytea": "binary",
    "date32": "date", "date64": "date", "int2": "smallint", "int4": "int", "bool": "boolean", "timestamptz": "timestamp", "largebinary": "binary",
}
#: Widths of whole numbers without a sign.
UNSIGNED = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "integer": "bigint", "bigint": "decimal(20,0)"}
#: fixed values: format letters of strftime and the patterns of the same fields here.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "I": "hh", "p": "a", "y": "yy", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "f": "SSSSSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "z": "xx", "Z": "zzz", "e": "d"}
#: Microseconds of the units that have a fixed length.
MICROS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
MONTHS = {"month": 1, "quarter": 3, "year": 12}
#: Words after which a bracket, a tilde or a sign starts an operand.
OPENERS = {"select", "where", "and", "or", "not", "on", "by", "when", "then", "else", "case", "in", "like", "ilike", "rlike", "between", "having", "limit", "offset", "values", "from", "distinct", "all", "qualify", "is", "as", "interval", "to"}
#: Words that end an ORDER BY list.
ENDS = {"limit", "offset", "fetch", "rows", "range", "groups", "union", "except", "intersect", "window", "for"}


class Unsupported(ValueError):
    """The statement asks for what the dialect has but Spark cannot express."""


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.lower() if self.kind == "word" else ""


def tokens(sql: str) -> list[Token]:
    """Tokens of a statement without its white space and comments."""
    out = []
    for m in TOKEN.finditer(sql):
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
    return out


def literal(text: str) -> str:
    """The value of a string literal; a backslash is a plain character."""
    return text[text.index("'") + 1 : -1].replace("''", "'")


def quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name_of(token: Token) -> str:
    """A name as it is written, without its quotes."""
    return token.text[1:-1].replace(token.text[0] * 2, token.text[0]) if token.kind == "quoted" else token.text


def closing(ts: list[Token], at: int) -> int:
    """Where the bracket that opens at a place closes."""
    pairs, depth = {"(": ")", "[": "]", "{": "}"}, 0
    for i in range(at, len(ts)):
        if ts[i].kind == "op":
            depth += (ts[i].text in pairs) - (ts[i].text in pairs.values())
            if depth == 0:
                return i
    raise Unsupported("a bracket is not closed")


def split(ts: list[Token], by: str = ",") -> list[list[Token]]:
    """The parts of a list between separators outside brackets; none of an empty list."""
    out, held, depth = [], [], 0
    for t in ts:
        if t.kind == "op":
            depth += (t.text in "([{") - (t.text in ")]}")
        if depth == 0 and t.kind == "op" and t.text == by:
            out.append(held)
            held = []
        else:
            held.append(t)
    return [*out, held] if out or held else []


def find(ts: list[Token], words: set[str], start: int = 0) -> int:
    """The first of some words outside brackets, or the end."""
    depth = 0
    for i in range(start, len(ts)):
        t = ts[i]
        if t.kind == "op":
            depth += (t.text in "([{") - (t.text in ")]}")
        elif depth == 0 and t.word in words:
            return i
    return len(ts)


def order_cut(ts: list[Token]) -> int:
    """Where ORDER BY stands outside brackets, or the end."""
    at = find(ts, {"order"})
    return at if at + 1 < len(ts) and ts[at + 1].word == "by" else len(ts)


@dataclass
class Call:
    """A call under translation: raw and translated arguments, ORDER BY inside it, and the clauses after it."""

    raw: list[list[Token]]
    args: list[str]
    order: list[tuple[str, bool]]
    distinct: bool
    filter: str = ""
    over: str = ""
    within: str = ""

    def text(self, i: int) -> str | None:
        """The i-th argument's value if it is a string literal."""
        ts = self.raw[i] if i < len(self.raw) else []
        return literal(ts[0].text) if len(ts) == 1 and ts[0].kind == "string" else None

    def arg(self, i: int, default: str) -> str:
        return self.args[i] if i < len(self.args) else default

    def rest(self) -> str:
        return "".join(f" {x}" for x in (self.within, self.filter, self.over) if x)


# -- calls ---------------------------------------------------------------------


def regex_of(c: Call, i: int, flags: int) -> str:
    """The i-th argument as a pattern with the flags of another argument."""
    given = c.text(flags) or ""
    prefix = "".join(f for f in given if f in "ims")
    return f"concat('(?{prefix})', {c.args[i]})" if prefix else c.args[i]


def regexp_match(c: Call) -> str:
    s, p, text = c.args[0], regex_of(c, 1, 2), c.text(1)
    groups = 0
    if text is not None:
        groups = re.compile(re.sub(r"\\[pP]\{[^}]*\}", "x", text)).groups
    found = ", ".join(f"regexp_extract({s}, {p}, {i})" for i in (range(1, groups + 1) if groups else [0]))
    return f"CASE WHEN regexp_like({s}, {p}) THEN array({found}) END"


def regexp_replace(c: Call) -> str:
    s, p = c.args[0], regex_of(c, 1, 3)
    text = c.text(2)
    r = quote(re.sub(r"\\(\d)|\$\{(\d+)\}", lambda m: "$" + (m[1] or m[2]), text)) if text is not None else c.args[2]
    if "g" in (c.text(3) or ""):
        return f"regexp_replace({s}, {p}, {r})"
    found = f"regexp_extract({s}, {p}, 0)"
    at = f"regexp_instr({s}, {p})"
    return f"CASE WHEN regexp_like({s}, {p}) THEN concat(substring({s}, 1, {at} - 1), regexp_replace({found}, {p}, {r}), substring({s}, {at} + length({found}))) ELSE {s} END"


def interval_of(ts: list[Token]) -> tuple[int, int]:
    """Months and microseconds of an interval literal."""
    words = [t for t in ts if t.word != "interval"]
    text = " ".join(literal(t.text) if t.kind == "string" else t.text for t in words).lower()
    months = micros = 0
    pairs = re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", text)
    if not pairs or re.sub(r"[+-]?\d+(?:\.\d+)?\s*[a-z]+", "", text).strip():
        raise Unsupported(f"no interval literal: {text}")
    for n, unit in pairs:
        unit = {"s": "second", "m": "minute", "h": "hour", "d": "day", "ms": "millisecond", "us": "microsecond"}.get(unit, unit.removesuffix("s"))
        if unit in MICROS:
            micros += round(float(n) * MICROS[unit])
        elif unit in MONTHS:
            months += int(float(n) * MONTHS[unit])
        else:
            raise Unsupported(f"no unit {unit}")
    return months, micros


def interval(months: int, micros: int) -> str:
    """An interval literal."""
    if months and micros:
        return f"make_interval(0, {months}, 0, 0, 0, 0, CAST({micros} / 1000000BD AS DECIMAL(18,6)))"
    if months:
        return f"INTERVAL '{months}' MONTH"
    days, rest = divmod(abs(micros), MICROS["day"])
    seconds, part = divmod(rest, 1_000_000)
    sign = "-" * (micros < 0)
    return f"INTERVAL '{sign}{days} {seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}.{part:06}' DAY TO SECOND"


def date_bin(c: Call) -> str:
    months, micros = interval_of(c.raw[0])
    t, origin = f"CAST({c.args[1]} AS TIMESTAMP)", c.arg(2, "")
    if months:
        if micros or origin:
            raise Unsupported("date_bin by months takes months alone and no origin")
        passed = f"(year({t}) * 12 + month({t}) - 1 - 1970 * 12)"
        return f"CAST(add_months(DATE'1970-01-01', CAST({passed} - pmod({passed}, {months}) AS INT)) AS TIMESTAMP)"
    us = f"unix_micros({t})"
    if origin:
        start = f"unix_micros(CAST({origin} AS TIMESTAMP))"
        return f"timestamp_micros({us} - pmod({us} - {start}, {micros}L))"
    return f"timestamp_micros({us} - pmod({us}, {micros}L))"


def date_part(unit: str, t: str) -> str:
    unit = unit.lower()
    if unit == "dow":
        return f"(dayofweek({t}) - 1)"
    if unit == "epoch":
        return f"(unix_micros(CAST({t} AS TIMESTAMP)) / 1000000D)"
    if unit in ("millisecond", "microsecond", "nanosecond"):
        scale = {"millisecond": 1_000, "microsecond": 1_000_000, "nanosecond": 1_000_000_000}[unit]
        return f"CAST(date_part('second', {t}) * {scale} AS INT)"
    return f"date_part({quote(unit)}, {t})"


def to_char(c: Call) -> str:
    text = c.text(1)
    if text is None:
        raise Unsupported("to_char needs a literal format")
    out, at = [], 0
    for m in re.finditer(r"%(?:\.?(\d)?)?([A-Za-z%])", text):
        plain = text[at : m.start()]
        out.append("'" + plain.replace("'", "''") + "'" if re.search(r"[A-Za-z']", plain) else plain)
        if m[2] != "%" and m[2] not in STRFTIME:
            raise Unsupported(f"no format {m[0]}")
        out.append("%" if m[2] == "%" else "S" * int(m[1] or 9) if m[2] == "f" else STRFTIME[m[2]])
        at = m.end()
    plain = text[at:]
    out.append("'" + plain.replace("'", "''") + "'" if re.search(r"[A-Za-z']", plain) else plain)
    return f"date_format({c.args[0]}, {quote(''.join(out))})"


def positions(a: str, v: str) -> str:
    return f"filter(transform({a}, (y_, j_) -> CASE WHEN y_ <=> {v} THEN j_ + 1 END), p_ -> p_ IS NOT NULL)"


def first_places(a: str, v: str, n: str) -> str:
    """Places, from 1, of the first n elements that equal a value."""
    return f"slice({positions(a, v)}, 1, CAST({n} AS INT))"


def replaced(a: str, v: str, to: str, n: str | None) -> str:
    hit = f"x_ <=> {v}" if n is None else f"array_contains({first_places(a, v, n)}, i_ + 1)"
    return f"transform({a}, (x_, i_) -> CASE WHEN {hit} THEN {to} ELSE x_ END)"


def removed(a: str, v: str, n: str) -> str:
    return f"filter({a}, (x_, i_) -> NOT array_contains({first_places(a, v, n)}, i_ + 1))"


def place(a: str, i: str) -> str:
    """A place from 1; negative ones count from the end."""
    return f"CASE WHEN {i} < 0 THEN size({a}) + {i} + 1 ELSE {i} END"


def array_slice(c: Call) -> str:
    a, lo, hi = c.args[0], place(c.args[0], c.args[1]), place(c.args[0], c.args[2])
    step = c.arg(3, "1")
    cut = f"slice({a}, CAST(greatest(1, {lo}) AS INT), CAST(greatest(0, {hi} - greatest(1, {lo}) + 1) AS INT))"
    return cut if step == "1" else f"filter({cut}, (x_, i_) -> i_ % {step} = 0)"


def exclusive_range(c: Call) -> str:
    a, b, step = ("0", c.args[0], "1") if len(c.args) == 1 else (c.args[0], c.args[1], c.arg(2, "1"))
    runs = f"(({step}) > 0 AND ({a}) < ({b})) OR (({step}) < 0 AND ({a}) > ({b}))"
    return f"CASE WHEN {runs} THEN filter(sequence({a}, {b}, {step}), x_ -> x_ <> ({b})) ELSE slice(array({a}), 1, 0) END"


def collected(c: Call, keep_nulls: bool = True) -> str:
    """Values of a group as an array, nulls included, in the order asked for."""
    x = c.args[0]
    if c.order and c.over:
        raise Unsupported("an ordered array over a window")
    if c.order:
        keys = ", ".join(f"'k{i}', {k}" for i, (k, _) in enumerate(c.order))
        up = {asc for _, asc in c.order}
        if len(up) > 1:
            raise Unsupported("an ordered array takes keys of one direction")
        rows = f"collect_list(named_struct({keys}, 'v', {x})){c.rest()}"
        return f"transform(sort_array({rows}, {str(up.pop()).lower()}), e_ -> e_.v)"
    distinct = "collect_set" if c.distinct else "collect_list"
    return f"transform({distinct}(named_struct('v', {x})){c.rest()}, e_ -> e_.v)"


def of_order(c: Call, first: bool) -> str:
    """first_value and last_value as aggregates with an order, or over a window."""
    name = "first_value" if first else "last_value"
    if c.over or not c.order:
        return f"{name}({', '.join(c.args)}){c.rest()}"
    keys = ", ".join(k for k, _ in c.order)
    up = {asc for _, asc in c.order}
    if len(up) > 1:
        raise Unsupported(f"{name} takes keys of one direction")
    return f"{'min_by' if first == up.pop() else 'max_by'}({c.args[0]}, struct({keys})){c.rest()}"


def nth_value(c: Call) -> str:
    return f"nth_value({', '.join(c.args)}){c.rest()}" if c.over else f"try_element_at({collected(c)}, CAST({c.args[1]} AS INT))"


def string_agg(c: Call) -> str:
    order = " WITHIN GROUP (ORDER BY " + ", ".join(f"{k} {'ASC NULLS LAST' if up else 'DESC NULLS FIRST'}" for k, up in c.order) + ")" if c.order else ""
    return f"listagg({'DISTINCT ' if c.distinct else ''}CAST({c.args[0]} AS STRING), {c.arg(1, quote(''))}){order}{c.rest()}"


def approximate(c: Call) -> str:
    """A percentile of the value, given as an argument or by WITHIN GROUP."""
    if c.within:
        m = re.match(r"(?is)WITHIN GROUP \(ORDER BY (.*?)( DESC| ASC)?( NULLS (?:FIRST|LAST))?\)$", c.within)
        share = f"1 - {c.args[0]}" if (m[2] or "").strip().upper() == "DESC" else c.args[0]
        return f"percentile_approx({m[1]}, {share}){' ' + c.filter if c.filter else ''}"
    return f"percentile_approx({c.args[0]}, {c.args[1]}){c.rest()}"


def concat(c: Call) -> str:
    """Concatenation in which a null is empty; of arrays it is the usual one."""
    first = c.raw[0][0].text if c.raw and c.raw[0] else ""
    if first == "[" or first.lower() in ("make_array", "array", "array_append"):
        return f"concat({', '.join(c.args)})"
    return "concat(" + ", ".join(f"coalesce(CAST({a} AS STRING), '')" for a in c.args) + ")"


def map_call(c: Call) -> str:
    listed = c.raw and c.raw[0] and c.raw[0][0].text.lower() in ("[", "make_array", "array")
    return f"{'map_from_arrays' if listed and len(c.args) == 2 else 'map'}({', '.join(c.args)})"


def encode(c: Call) -> str:
    data = f"CAST({c.args[0]} AS BINARY)"
    return f"rtrim('=', base64({data}))" if (c.text(1) or "").lower() == "base64" else f"lower(hex({data}))"


def decode(c: Call) -> str:
    return f"unbase64({c.args[0]})" if (c.text(1) or "").lower() == "base64" else f"unhex({c.args[0]})"


def digest(c: Call) -> str:
    name = (c.text(1) or "").lower()
    if name == "md5":
        return f"md5(CAST({c.args[0]} AS BINARY))"
    if name not in ("sha224", "sha256", "sha384", "sha512"):
        raise Unsupported(f"no digest {name}")
    return f"sha2(CAST({c.args[0]} AS BINARY), {name[3:]})"


def reduced(a: str, b: str) -> str:
    """Greatest common divisor by Euclid's steps."""
    start = f"named_struct('x', abs(CAST({a} AS BIGINT)), 'y', abs(CAST({b} AS BIGINT)))"
    return f"aggregate(sequence(1, 92), {start}, (p_, i_) -> CASE WHEN p_.y = 0 THEN p_ ELSE named_struct('x', p_.y, 'y', p_.x % p_.y) END, p_ -> p_.x)"


def lcm(c: Call) -> str:
    a, b = c.args
    return f"CASE WHEN {a} = 0 OR {b} = 0 THEN 0L ELSE abs((CAST({a} AS BIGINT) DIV {reduced(a, b)}) * CAST({b} AS BIGINT)) END"


def truncated(c: Call) -> str:
    scale = f"power(10D, {c.args[1]})" if len(c.args) > 1 else "1D"
    return f"(signum({c.args[0]}) * floor(abs({c.args[0]}) * {scale}) / {scale})"


def nanos(c: Call) -> str:
    if c.text(0) is not None:
        return f"to_timestamp({c.args[0]})"
    return f"timestamp_micros((CAST({c.args[0]} AS BIGINT) - pmod(CAST({c.args[0]} AS BIGINT), 1000L)) DIV 1000L)"


def a(form: str) -> Callable[[Call], str]:
    """A call whose translation is a text with the arguments in it."""
    return lambda c: form.format(*c.args) + c.rest()


CALLS: dict[str, Callable[[Call], str]] = {
    "regexp_match": regexp_match, "regexp_replace": regexp_replace, "date_bin": date_bin, "to_char": to_char, "array_slice": array_slice, "range": exclusive_range, "array_agg": collected, "nth_value": nth_value,
    "string_agg": string_agg, "approx_percentile_cont": approximate, "concat": concat, "map": map_call, "encode": encode, "decode": decode, "digest": digest, "lcm": lcm, "trunc": truncated, "to_timestamp_nanos": nanos,
    "regexp_like": lambda c: f"regexp_like({c.args[0]}, {regex_of(c, 1, 2)})",
    "regexp_count": lambda c: f"regexp_count({c.args[0]}, {regex_of(c, 1, 3)})",
    "first_value": lambda c: of_order(c, True), "last_value": lambda c: of_order(c, False),
    "gcd": lambda c: reduced(*c.args),
    "log": lambda c: f"log10({c.args[0]})" if len(c.args) == 1 else f"log({c.args[0]}, {c.args[1]})",
    "iszero": a("({0} = 0)"), "to_hex": a("lower(hex({0}))"), "to_unixtime": a("unix_seconds(CAST({0} AS TIMESTAMP))"), "to_local_time": a("CAST({0} AS TIMESTAMP_NTZ)"),
    "btrim": lambda c: f"trim({c.args[0]})" if len(c.args) == 1 else f"trim(BOTH {c.args[1]} FROM {c.args[0]})",
    "sha224": a("sha2(CAST({0} AS BINARY), 224)"), "sha256": a("sha2(CAST({0} AS BINARY), 256)"), "sha384": a("sha2(CAST({0} AS BINARY), 384)"), "sha512": a("sha2(CAST({0} AS BINARY), 512)"),
    "md5": a("md5(CAST({0} AS BINARY))"),
    "approx_median": a("percentile_approx({0}, 0.5)"), "approx_percentile_cont_with_weight": a("percentile({0}, {2}, CAST({1} AS BIGINT))"),
    "array_has_all": a("(size(array_except({1}, {0})) = 0)"), "array_empty": a("(size({0}) = 0)"), "empty": a("(size({0}) = 0)"), "array_length": a("size({0})"), "list_length": a("size({0})"),
    "array_ndims": a("regexp_count(typeof({0}), 'array<')"), "array_position": a("nullif(array_position({0}, {1}), 0)"), "array_positions": lambda c: positions(c.args[0], c.args[1]),
    "array_remove": lambda c: removed(c.args[0], c.args[1], "1"), "array_remove_all": a("array_remove({0}, {1})"), "array_remove_n": lambda c: removed(*c.args),
    "array_replace": lambda c: replaced(*c.args, "1"), "array_replace_n": lambda c: replaced(*c.args), "array_replace_all": lambda c: replaced(*c.args, None),
    "array_resize": lambda c: f"slice(concat({c.args[0]}, array_repeat({c.arg(2, 'NULL')}, CAST({c.args[1]} AS INT))), 1, CAST({c.args[1]} AS INT))",
    "array_to_string": lambda c: f"array_join(transform({c.args[0]}, x_ -> CAST(x_ AS STRING)), {', '.join(c.args[1:])})",
    "string_to_array": lambda c: f"split({c.args[0]}, {quote(re.escape(c.text(1)))})" if c.text(1) is not None else f"split({c.args[0]}, concat('\\\\Q', {c.args[1]}, '\\\\E'))",
    "array_pop_back": a("slice({0}, 1, greatest(size({0}) - 1, 0))"), "array_pop_front": a("slice({0}, 2, greatest(size({0}) - 1, 0))"),
    "array_sort": lambda c: f"sort_array({c.args[0]}, {str((c.text(1) or 'ASC').upper() != 'DESC').lower()})",
    "map_extract": a("CASE WHEN map_contains_key({0}, {1}) THEN array({0}[{1}]) ELSE array(NULL) END"),
    "arrow_cast": lambda c: f"CAST({c.args[0]} AS {type_name(c.text(1) or '')})",
    "get_field": lambda c: f"({c.args[0]})[{c.args[1]}]",
    "date_part": lambda c: date_part(c.text(0) or "", c.args[1]),
}


def type_name(text: str) -> str:
    """A type of the dialect as Spark names it."""
    words = text.lower().split()
    if words[-1:] == ["unsigned"]:
        return UNSIGNED.get(words[0], "decimal(20,0)")
    if words[:2] == ["double", "precision"]:
        return "double"
    if words[:1] == ["timestamp"]:
        return "timestamp" if words[1:2] == ["with"] else "timestamp_ntz" if words[1:2] == ["without"] else "timestamp"
    base = re.match(r"[a-z_0-9]*", words[0] if words else "")[0]
    if base == "timestamp":
        return "timestamp"
    return TYPES.get(base, text)


class Translator:
    """One statement; ``parameters`` counts the placeholders met, whose n-th is named ``p<n>``."""

    def __init__(self):
        self.parameters = 0

    def text(self, ts: list[Token]) -> str:
        ts = self.clauses(ts)
        out: list[str] = []
        start = -1  # where the last operand begins in ``out``, or -1 after an operator
        i = 0
        while i < len(ts):
            t = ts[i]
            begin = len(out)
            if t.kind == "string":
                out.append(quote(literal(t.text)))
            elif t.kind == "quoted":
                out.append("`" + name_of(t).replace("`", "``") + "`")
            elif t.kind == "param":
                if t.text == "?":
                    self.parameters += 1
                    out.append(f":p{self.parameters}")
                else:
                    self.parameters = max(self.parameters, int(t.text[1:]))
                    out.append(f":p{t.text[1:]}")
            elif t.kind == "word":
                i, start = self.word(ts, i, out, start)
                continue
            elif t.kind == "number":  # a number with a point is a double, not a decimal
                out.append(t.text if t.text.isdigit() else f"{t.text}{'0' * t.text.endswith('.')}D")
            elif t.text == "[":
                end = closing(ts, i)
                inside = ts[i + 1 : end]
                if start < 0:
                    out.append("array(" + ", ".join(map(self.text, split(inside))) + ")")
                else:
                    operand, begin = " ".join(out[start:]), start
                    del out[start:]
                    out.append(self.indexed(operand, inside))
                start = begin
                i = end + 1
                continue
            elif t.text == "(":
                end = closing(ts, i)
                out.append("(" + self.text(ts[i + 1 : end]) + ")")
                start = begin if start < 0 else start
                i = end + 1
                continue
            elif t.text == "::":
                end = self.type_end(ts, i + 1)
                operand = " ".join(out[start:]) if start >= 0 else ""
                del out[max(start, 0) :]
                out.append(f"CAST({operand} AS {self.type_text(ts[i + 1 : end])})")
                start, i = len(out) - 1, end
                continue
            elif t.text == ":" and i + 1 < len(ts) and ts[i + 1].kind == "word":
                out.append(f":{ts[i + 1].text}")
                start, i = begin, i + 2
                continue
            elif t.text == ".":
                out.append(".")
                i += 1
                if i < len(ts):
                    n = ts[i]
                    out.append("`" + name_of(n).replace("`", "``") + "`" if n.kind == "quoted" else n.text)
                    i += 1
                joined = "".join(out[start:]) if start >= 0 else None
                if joined is not None:
                    del out[start:]
                    out.append(joined)
                continue
            else:
                i = self.operator(t, out, start, i)
                start = -1
                continue
            start = begin if t.kind != "op" else -1
            i += 1
        return " ".join(out)

    def operator(self, t: Token, out: list[str], start: int, i: int) -> int:
        operators = {"~": "RLIKE", "!~": "NOT RLIKE", "~*": "RLIKE '(?i)' ||", "!~*": "NOT RLIKE '(?i)' ||", "#": "^"}
        out.append(operators[t.text] if t.text in operators and start >= 0 else t.text)
        return i + 1

    def indexed(self, operand: str, inside: list[Token]) -> str:
        parts = split(inside, ":")
        if len(parts) > 1:
            given = [self.text(p) if p else d for p, d in zip(parts, ("1", f"size({operand})", "1"))]
            return array_slice(Call([], [operand, *given], [], False))
        if len(inside) == 1 and inside[0].kind == "string":
            return f"{operand}[{self.text(inside)}]"
        return f"try_element_at({operand}, {self.text(inside)})"

    def word(self, ts: list[Token], i: int, out: list[str], start: int) -> tuple[int, int]:
        """Translates a word and what belongs to it; the next place, and where its operand begins."""
        t, after = ts[i], ts[i + 1] if i + 1 < len(ts) else Token("op", "")
        begin = len(out)
        if t.word == "information_schema" and after.text == ".":
            out.append(f"information_schema_{name_of(ts[i + 2]).lower()}")
            return i + 3, begin
        if t.word == "similar" and after.word == "to":
            out.append("RLIKE '^(?:' ||")
            pattern, end = self.operand(ts, i + 2)
            out.append(f"{pattern} || ')$'")
            return end, -1
        if t.word == "array" and after.text == "[":
            return i + 1, -1
        if t.word == "map" and after.text == "{":
            end = closing(ts, i + 1)
            pairs = [split(p, ":") for p in split(ts[i + 2 : end])]
            out.append("map(" + ", ".join(self.text(x) for p in pairs for x in p) + ")")
            return end + 1, begin
        if t.word == "interval" and after.kind == "string":
            unit = ts[i + 2].word if i + 2 < len(ts) else ""
            named = unit.removesuffix("s") in MICROS | MONTHS
            out.append(interval(*interval_of(ts[i : i + 2 + named])))
            return i + 2 + named, begin
        if t.word in ("date", "timestamp", "time") and after.kind == "string":
            out.append(f"{t.text} {quote(literal(after.text))}")
            return i + 2, begin
        if after.text == "(" and t.word not in OPENERS | {"over", "filter", "group", "using", "exists", "any", "lateral", "some", "sets", "cube", "rollup", "recursive", "join", "union", "except", "intersect", "table", "end", "with", "set"} and not (start >= 0 and i and ts[i - 1].word == "as"):
            end = closing(ts, i + 1)
            text, end = self.call(t.word, ts, i + 2, end)
            out.append(text)
            return end, begin
        out.append(t.text)
        return i + 1, -1 if t.word in OPENERS else begin

    def operand(self, ts: list[Token], i: int) -> tuple[str, int]:
        """One literal, name or call at a place, and what follows it."""
        if ts[i].kind == "word" and i + 1 < len(ts) and ts[i + 1].text == "(":
            end = closing(ts, i + 1) + 1
        elif ts[i].text == "(":
            end = closing(ts, i) + 1
        else:
            end = i + 1
            while end + 1 < len(ts) and ts[end].text == ".":
                end += 2
        return self.text(ts[i:end]), end

    def call(self, name: str, ts: list[Token], lo: int, hi: int) -> tuple[str, int]:
        """A call's translation with the clauses after it, and the place after them."""
        body, at = ts[lo:hi], hi + 1
        if name in ("cast", "try_cast", "safe_cast"):
            cut = find(body, {"as"})
            kind = "TRY_CAST" if name != "cast" else "CAST"
            return f"{kind}({self.text(body[:cut])} AS {self.type_text(body[cut + 1 :])})", at
        if name == "extract":
            cut = find(body, {"from"})
            unit = literal(body[0].text) if body[0].kind == "string" else body[0].text
            return date_part(unit, self.text(body[cut + 1 :])), at
        if name in ("substring", "overlay", "position", "trim") and find(body, {"from", "placing", "in"}) < len(body):
            return f"{name}({self.text(body)})", at
        distinct = bool(body) and body[0].word == "distinct"
        body = body[1:] if distinct else body
        cut = order_cut(body)
        order = [self.key(k) for k in split(body[cut + 2 :])]
        raw = split(body[:cut])
        c = Call(raw, [self.text(x) for x in raw], order, distinct)
        while at < len(ts):
            if ts[at].word == "within" and at + 2 < len(ts) and ts[at + 1].word == "group":
                end = closing(ts, at + 2)
                c.within = f"WITHIN GROUP ({self.text(ts[at + 3 : end])})"
            elif ts[at].word == "filter" and at + 1 < len(ts) and ts[at + 1].text == "(":
                end = closing(ts, at + 1)
                c.filter = f"FILTER ({self.text(ts[at + 2 : end])})"
            elif ts[at].word in ("ignore", "respect") and at + 1 < len(ts) and ts[at + 1].word == "nulls":
                end = at + 1
                c.filter = f"{ts[at].text} NULLS"
            elif ts[at].word == "over" and at + 1 < len(ts):
                end = closing(ts, at + 1) if ts[at + 1].text == "(" else at + 1
                c.over = f"OVER ({self.text(ts[at + 2 : end])})" if end > at + 1 else f"OVER {ts[end].text}"
            else:
                break
            at = end + 1
        if name in CALLS:
            return CALLS[name](c), at
        name = RENAMED.get(name, name)
        if name in CALLS:
            return CALLS[name](c), at
        if c.order:
            raise Unsupported(f"{name} with an order")
        return f"{name}({'DISTINCT ' if distinct else ''}{', '.join(c.args)}){c.rest()}", at

    def key(self, ts: list[Token]) -> tuple[str, bool]:
        """A sort key without its direction, and whether it ascends."""
        nulls = find(ts, {"nulls"})
        ts = ts[:nulls] if nulls + 1 < len(ts) and ts[nulls + 1].word in ("first", "last") else ts
        up = not ts or ts[-1].word != "desc"
        return self.text(ts[:-1] if ts and ts[-1].word in ("asc", "desc") else ts), up

    @staticmethod
    def type_end(ts: list[Token], i: int) -> int:
        end = i + 1
        if ts[i].word == "double" and end < len(ts) and ts[end].word == "precision" or end < len(ts) and ts[end].word == "unsigned":
            end += 1
        elif ts[i].word in ("timestamp", "time") and end < len(ts) and ts[end].word in ("with", "without"):
            end += 3
        if end < len(ts) and ts[end].text == "(":
            end = closing(ts, end) + 1
        return end

    @staticmethod
    def type_text(ts: list[Token]) -> str:
        words = " ".join(t.text for t in ts if t.kind == "word")
        if ts and ts[0].word in ("decimal", "numeric"):
            return "decimal" + "".join(t.text for t in ts[1:])
        if any(t.text == "<" for t in ts):
            return " ".join(t.text for t in ts)
        return type_name(words)

    # -- clauses ---------------------------------------------------------------

    def clauses(self, ts: list[Token]) -> list[Token]:
        """QUALIFY and DISTINCT ON as subqueries; the order of nulls spelled out."""
        return self.null_order(self.distinct_on(self.qualify(ts)))

    @staticmethod
    def null_order(ts: list[Token]) -> list[Token]:
        """Nulls come last in ascending and first in descending order."""
        out, i = [], 0
        while i < len(ts):
            if ts[i].kind == "op" and ts[i].text in ("(", "[", "{"):  # what is inside is translated by itself
                end = closing(ts, i) + 1
                out += ts[i:end]
                i = end
                continue
            out.append(ts[i])
            if not (ts[i].word == "order" and i + 1 < len(ts) and ts[i + 1].word == "by"):
                i += 1
                continue
            out.append(ts[i + 1])
            end = min(find(ts, ENDS, i + 2), next((k for k in range(i + 2, len(ts)) if ts[k].text == ";"), len(ts)))
            keys = split(ts[i + 2 : end])
            for n, k in enumerate(keys):
                if n:
                    out.append(Token("op", ","))
                out += k
                if not any(x.word == "nulls" for x in k[-2:]):
                    out += [Token("word", "NULLS"), Token("word", "FIRST" if k and k[-1].word == "desc" else "LAST")]
            i = end
        return out

    @staticmethod
    def qualify(ts: list[Token]) -> list[Token]:
        at = find(ts, {"qualify"})
        if at == len(ts):
            return ts
        select = find(ts, {"select"})
        source = find(ts, {"from"}, select)
        end = find(ts, {"order", "limit", "union", "except", "intersect", "window"}, at)
        w = lambda x: [Token("word", v) if v[0].isalpha() or v[0] == "_" else Token("op", v) for v in x.split()]
        inner = [*ts[select:source], *w(", ("), *ts[at + 1 : end], *w(") AS qualified_"), *ts[source:at]]
        return [*ts[:select], *w("SELECT * EXCEPT ( qualified_ ) FROM ("), *inner, *w(") WHERE qualified_"), *ts[end:]]

    @staticmethod
    def distinct_on(ts: list[Token]) -> list[Token]:
        select = find(ts, {"select"})
        if [t.word for t in ts[select + 1 : select + 3]] != ["distinct", "on"]:
            return ts
        close = closing(ts, select + 3)
        source = find(ts, {"from"}, close + 1)
        order = source + order_cut(ts[source:])
        end = find(ts, {"limit", "offset", "fetch", "union", "except", "intersect"}, min(order, len(ts)) if order < len(ts) else source)
        order = min(order, end)
        keys = split(ts[order + 2 : end])
        w = lambda x: [Token("word", v) if v[0].isalpha() or v[0] == "_" else Token("op", v) for v in x.split()]
        extra, outer = [], []
        for n, k in enumerate(keys):
            tail = find(k, {"asc", "desc", "nulls"})
            extra += [*w(","), *k[:tail], *w(f"AS order_{n}_")]
            outer += [*(w(",") if n else w("ORDER BY")), *w(f"order_{n}_"), *k[tail:]]
        over = [*w("PARTITION BY"), *ts[select + 4 : close], *w("ORDER BY"), *(ts[order + 2 : end] or ts[select + 4 : close])]
        inner = [*w("SELECT"), *ts[close + 1 : source], *extra, *w(", row_number ( ) OVER ("), *over, *w(") AS place_"), *ts[source:order]]
        hidden = w(" , ".join(["place_", *(f"order_{n}_" for n in range(len(keys)))]))
        return [*ts[:select], *w("SELECT * EXCEPT ("), *hidden, *w(") FROM ("), *inner, *w(") WHERE place_ ="), Token("number", "1"), *outer, *ts[end:]]


def translated(sql: str) -> str:
    """A statement in Spark's SQL."""
    return Translator().text(tokens(sql))
