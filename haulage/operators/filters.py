"""The selection language over entries, compiled to columns.

Conditions (`name`, `extension`, `type`, `size`, `modified`, `path`, `dir_date`) are joined by `and` and `or` with
parentheses; `and` binds tighter. A condition gives a verdict rather than a truth value: directories may match in
part, and a mismatch may or may not rule out what lies below. Only the expression's text is parsed on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.functions.columns import floor_div, path_components, path_extension, path_name, trunc_div

PATH, NONPATH, MIXED, PARTIAL, FULL, OTHER, LAZY = range(1, 8)
_OPS = ("==", "!=", "<=", ">=", "<", ">")
_DAY = 86_400


def glob_regex(glob: str) -> str:
    """Java regex of a glob whose wildcards never cross a slash, but for `**` as a whole component."""
    parts, out = glob.split("/"), []
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append(".+" if last and k else ".*" if last else "(?:[^/]+/)*")
            continue
        if "**" in part:
            raise ValueError(f"in the glob '{glob}', ** is not a whole component")
        out.append(_component(part, glob) + ("" if last else "/"))
    return "(?s)^" + "".join(out) + "$"


def _component(part: str, glob: str) -> str:
    out, i = [], 0
    while i < len(part):
        c = part[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = part.find("]", i + (3 if part[i + 1 : i + 2] == "!" else 2))
            if end < 0:
                raise ValueError(f"in the glob '{glob}', a [ is not closed")
            body = part[i + 1 : end]
            no, body = body.startswith("!"), body.lstrip("!") if body.startswith("!") else body
            body = re.sub(r"([\\\[\]^&])", r"\\\1", body)
            out.append(f"(?!/)[^{body}]" if no else f"(?!/)[{body}]")
            i = end
        else:
            out.append(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", c))
        i += 1
    return "".join(out)


@dataclass
class Condition:
    field: str
    op: str
    value: str


def _tokens(expr: str) -> list:
    """Parentheses, `and`, `or` and conditions; double quotes protect the words inside a value. Other text is dropped."""
    out: list = []
    i, start = 0, 0
    quoted = False

    def close(end: int) -> None:
        if (c := _condition(expr[start:end].strip())) is not None:
            out.append(c)

    while i < len(expr):
        ch = expr[i]
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in "()":
            close(i)
            out.append(ch)
            start = i + 1
        elif not quoted and (m := re.match(r"(and|or)(?=[\s(]|$)", expr[i:])) and (i == 0 or expr[i - 1] in " \t\n()"):
            close(i)
            out.append(m[1])
            i += len(m[1]) - 1
            start = i + 1
        i += 1
    close(len(expr))
    return out


def _condition(text: str) -> Condition | None:
    for op in _OPS:
        if (at := text.find(op)) >= 0:
            field, value = text[:at].strip(), text[at + len(op) :].strip()
            if field in ("name", "extension", "type", "size", "modified", "path", "dir_date"):
                return Condition(field, op, value)
            raise ValueError(f"Unknown field: {field}")
    return None


def parse(expr: str):
    """Nested ('and' | 'or', left, right) tuples over conditions."""
    tokens, at = _tokens(expr), 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def either():
        nonlocal at
        left = both()
        while peek() == "or":
            at += 1
            left = ("or", left, both())
        return left

    def both():
        nonlocal at
        left = one()
        while peek() == "and":
            at += 1
            left = ("and", left, one())
        return left

    def one():
        nonlocal at
        t = peek()
        if t is None or t in ("and", "or", ")"):
            raise ValueError("Unexpected end of expression" if t is None else f"Unexpected '{t}'")
        at += 1
        if t == "(":
            inner = either()
            if peek() != ")":
                raise ValueError("Missing closing parenthesis")
            at += 1
            return inner
        return t

    tree = either()
    if peek() is not None:
        raise ValueError("Unexpected text after the expression")
    return tree


def _unquote(value: str) -> str:
    v = value.strip()
    return v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v


def civil_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a civil date; days beyond a month's end roll over."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = floor_div(y2, 400)
    yoe = y2 - era * 400
    doy = trunc_div((m + F.when(m > 2, -3).otherwise(9)) * 153 + 2, 5) + d - 1
    return era * 146_097 + yoe * 365 + trunc_div(yoe, 4) - trunc_div(yoe, 100) + doy - 719_468


def _days(y: int, m: int, d: int) -> int:
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    return era * 146_097 + yoe * 365 + yoe // 4 - yoe // 100 + ((m + (-3 if m > 2 else 9)) * 153 + 2) // 5 + d - 1 - 719_468


def _epoch(text: str) -> int:
    """Seconds of YYYY-MM-DD, YYYY-MM-DDTHH:MM:SS, YYYYMMDD or YYMMDD."""
    if m := re.fullmatch(r"(\d+)-(\d+)-(\d+)(?:T(\d+):(\d+):(\d+))?", text):
        y, mo, d, h, mi, s = (int(x or 0) for x in m.groups())
        return _days(y, mo, d) * _DAY + h * 3600 + mi * 60 + s
    if re.fullmatch(r"\d{8}", text):
        return _days(int(text[:4]), int(text[4:6]), int(text[6:])) * _DAY
    if re.fullmatch(r"\d{6}", text):
        return _days(2000 + int(text[:2]), int(text[2:4]), int(text[4:])) * _DAY
    raise ValueError(f"Invalid date: {text}")


def extract_dir_date(name: Column) -> Column:
    """Epoch seconds of the first valid date in a directory name, else null: YYYY-MM-DD anywhere first, then the first
    digit run that validates (eight or more digits as YYYYMMDD from 1900 on, exactly six as 20YYMMDD)."""
    number = lambda s, a, n: F.substring(s, a, n).try_cast("long")
    valid = lambda m, d: (m >= 1) & (m <= 12) & (d >= 1) & (d <= 31)
    iso = F.filter(F.regexp_extract_all(name, F.lit(r"(?=([0-9]{4}-[0-9]{2}-[0-9]{2}))"), F.lit(1)), lambda s: valid(number(s, 6, 2), number(s, 9, 2)))
    runs = F.regexp_extract_all(name, F.lit(r"([0-9]+)"), F.lit(1))
    eight = lambda s: (F.length(s) >= 8) & (number(s, 1, 4) >= 1900) & valid(number(s, 5, 2), number(s, 7, 2))
    six = lambda s: (F.length(s) == 6) & valid(number(s, 3, 2), number(s, 5, 2))
    run = F.get(F.filter(runs, lambda s: eight(s) | six(s)), 0)
    date = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))

    def parts(f: Column) -> Column:
        told = F.when(f.iso.isNotNull(), date(number(f.iso, 1, 4), number(f.iso, 6, 2), number(f.iso, 9, 2)))
        told = told.when(F.length(f.run) == 6, date(number(f.run, 1, 2) + 2000, number(f.run, 3, 2), number(f.run, 5, 2)))
        return told.when(f.run.isNotNull(), date(number(f.run, 1, 4), number(f.run, 5, 2), number(f.run, 7, 2)))

    # each step's result is bound by a transform, so that the plan names no step twice
    found = F.transform(F.array(F.struct(F.get(iso, 0).alias("iso"), run.alias("run"))), parts)
    return F.get(F.transform(found, lambda p: civil_days(p.y, p.m, p.d)), 0) * _DAY


def _compare(op: str, a: Column, b) -> Column:
    return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _verdict(match: Column) -> Column:
    return F.get(F.lit([OTHER, NONPATH, LAZY]), F.coalesce(match.cast("int"), F.lit(2)))


@dataclass
class Inputs:
    """The columns that a condition looks at."""

    path: Column = None
    is_dir: Column = None
    is_symlink: Column = None
    size: Column = None
    mtime_ns: Column = None
    now: int = 0

    def __post_init__(self):
        self.path = F.col("relative_path") if self.path is None else self.path
        self.is_dir = F.col("is_dir") if self.is_dir is None else self.is_dir
        self.is_symlink = F.lit(False) if self.is_symlink is None else self.is_symlink
        self.size = F.col("size") if self.size is None else self.size
        self.mtime_ns = F.col("mtime_ns") if self.mtime_ns is None else self.mtime_ns

    @staticmethod
    def of(df: DataFrame, now: int = 0) -> Inputs:
        """The columns of df; without is_dir or is_symlink no entry is one."""
        has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in df.columns else F.lit(False)
        return Inputs(is_dir=has("is_dir"), is_symlink=has("is_symlink"), now=now)


def _dir_date(c: Condition, x: Inputs) -> tuple[Column, Column]:
    when, limit = extract_dir_date(path_name(x.path)), _epoch(_unquote(c.value))
    return when, _compare(c.op, trunc_div(when, _DAY), limit // _DAY) if c.op in ("==", "!=") else _compare(c.op, when, limit)


def dir_date_holds(c: Condition, x: Inputs) -> Column:
    """Whether the name has a date that meets the condition; false without a date."""
    return F.coalesce(_dir_date(c, x)[1], F.lit(False))


def _leaf(c: Condition, x: Inputs) -> Column:
    if c.field in ("name", "extension"):
        value = path_name(x.path) if c.field == "name" else F.when(~x.is_dir, F.coalesce(path_extension(x.path), F.lit("")))
        hit = value.rlike(glob_regex(_unquote(c.value)))
        return _verdict(hit if c.op == "==" else ~hit if c.op == "!=" else F.lit(False))
    if c.field == "type":
        kind = _unquote(c.value)
        if kind not in ("file", "dir", "symlink"):
            raise ValueError(f"type must be file, dir or symlink, not {kind}")
        own = F.when(x.is_dir, "dir").when(x.is_symlink, "symlink").otherwise("file")
        return _verdict(own == kind if c.op == "==" else own != kind if c.op == "!=" else F.lit(False))
    if c.field == "size":
        value = _unquote(c.value)
        if not re.fullmatch(r"\d+", value):
            raise ValueError(f"size must be a whole number of bytes, not {value}")
        return _verdict(F.when(x.size.isNotNull(), F.lit(False) if c.op == "!=" else _compare(c.op, x.size, int(value))))
    if c.field == "modified":
        return _modified(c, x)
    if c.field == "dir_date":
        when, hit = _dir_date(c, x)
        return F.when(~x.is_dir | when.isNull(), F.lit(NONPATH)).when(hit, F.lit(PATH)).otherwise(F.lit(FULL))
    return _path(c, x)


def _modified(c: Condition, x: Inputs) -> Column:
    text, bare = c.value.strip(), _unquote(c.value)
    secs = floor_div(x.mtime_ns, 1_000_000_000)
    if (bare != text and ("-" in bare or "T" in bare)) or (re.fullmatch(r"[+-]?\d+", bare) and int(bare) >= 10_000_000):
        limit = _epoch(bare)
        if c.op in ("==", "!="):
            return _verdict(_compare(c.op, trunc_div(secs, _DAY), int(limit / _DAY) if limit < 0 else limit // _DAY))
        return _verdict(_compare(c.op, secs, limit))
    try:
        days = float(re.match(r"[0-9.]*", bare)[0] if bare and bare[-1].isalpha() else bare)
    except ValueError as e:
        raise ValueError(f"modified must be a date, a time or days, not {bare}") from e
    if c.op == "==":
        raise ValueError("an age in days cannot be compared by ==")
    age = (F.lit(x.now) - secs) / F.lit(86_400.0)
    return _verdict(F.when(secs.isNotNull(), F.lit(False) if c.op == "!=" else _compare(c.op, age, days)))


def _path(c: Condition, x: Inputs) -> Column:
    pattern = _unquote(c.value).rstrip("/")
    regex, parts = glob_regex(pattern), [p for p in pattern.split("/") if p]
    depth, deep = len(parts), "**" in parts
    after = parts[parts.index("**") + 1 :] if deep else []
    own = path_components(x.path)
    head = lambda n: F.array_join(F.slice(own, 1, n), "/")
    if deep:
        least = max(1, parts.index("**") + len(after))
        above = F.when(F.size(own) > least, F.exists(F.sequence(F.lit(least), F.size(own) - 1), lambda n: head(n).rlike(regex))).otherwise(F.lit(False))
    else:
        above = head(depth).rlike(regex)
    hit = x.path.rlike(regex) | ((F.size(own) > depth) & above)
    n = F.size(own)
    partial = F.lit(OTHER)
    for k in range(depth, 0, -1):
        some = parts[:k]
        if "**" in some[:-1]:
            continue
        ok = x.path.rlike(glob_regex("/".join(some)))
        if some[-1] == "**" and after:
            ok = ok & path_name(x.path).rlike(glob_regex(after[0]))
        here = n >= k if some[-1] == "**" else n == k
        partial = F.when(here, F.when(ok, F.lit(PARTIAL)).otherwise(F.lit(OTHER))).otherwise(partial)
    if not deep:
        partial = F.when(n >= depth, F.lit(FULL)).otherwise(partial)
    verdict = F.when(hit, F.lit(PATH)).when(~x.is_dir, F.lit(FULL)).otherwise(partial)
    if c.op == "==":
        return verdict
    if c.op == "!=":
        return F.when(hit, F.lit(FULL)).when(verdict == PARTIAL, F.lit(OTHER)).otherwise(F.lit(PATH))
    return F.lit(OTHER)


def _and(a: int, b: int) -> int:
    if a in (FULL, OTHER):
        return a
    if b in (FULL, OTHER):
        return b
    if PARTIAL in (a, b):
        return PARTIAL
    if a == LAZY or b == LAZY or a == b:
        return b if a == LAZY else a
    return MIXED


def _or(a: int, b: int) -> int:
    for v in (a, b):
        if v in (PATH, NONPATH, MIXED):
            return v
    if PARTIAL in (a, b):
        return PARTIAL
    if a == LAZY or b == LAZY:
        return b if a == LAZY else a
    return FULL if FULL in (a, b) else OTHER


def _looked_up(rule, a: Column, b: Column) -> Column:
    """rule(a, b) from a table over all pairs of verdicts, so that each operand is evaluated once."""
    return F.get(F.lit([rule(i, j) if i and j else 0 for i in range(8) for j in range(8)]), a * 8 + b)


def verdict_and(a: Column, b: Column) -> Column:
    return _looked_up(_and, a, b)


def verdict_or(a: Column, b: Column) -> Column:
    return _looked_up(_or, a, b)


def evaluate(expr: str, inputs: Inputs | None = None) -> Column:
    """Verdict code of an expression for each row."""
    x = inputs or Inputs()

    def walk(node) -> Column:
        if isinstance(node, Condition):
            return _leaf(node, x)
        op, left, right = node
        return (verdict_and if op == "and" else verdict_or)(walk(left), walk(right))

    return walk(parse(expr))


def _decision(exclude: int, match: int) -> int:
    """Skip (4), check children (1), and continue always (2), never, or in directories only (8)."""
    if exclude in (PATH, MIXED):
        return 4
    if exclude in (NONPATH, PARTIAL):
        return 4 | 1 | (8 if exclude == NONPATH else 2)
    if match in (PATH, NONPATH, MIXED, LAZY):
        return 8 if match == PATH else 8 | 1
    return 4 if match == FULL else 4 | 1 | 8


def should_skip(match: str | None, exclude: str | None, inputs: Inputs | None = None) -> Column:
    """struct(skip, continue_scan, check_children): exclusion first, then the match."""
    x = inputs or Inputs()
    e = evaluate(exclude, x) if exclude and exclude.strip() else F.lit(LAZY)
    m = evaluate(match, x) if match and match.strip() else F.lit(LAZY)
    codes = [(_decision(i, j) if i and j else 0, d) for i in range(8) for j in range(8) for d in (False, True)]
    told = [F.struct(F.lit(bool(c & 4)).alias("skip"), F.lit(bool(c & 2 or (c & 8 and d))).alias("continue_scan"), F.lit(bool(c & 1)).alias("check_children")) for c, d in codes]
    return F.get(F.array(*told), (e * 8 + m) * 2 + F.coalesce(x.is_dir, F.lit(False)).cast("int"))


def filter_entries(df: DataFrame, match: str | None = None, exclude: str | None = None, now: int = 0) -> DataFrame:
    """Entries that are not skipped, every row judged alone. Without an is_dir or is_symlink column no entry is one; a
    null size or time meets no condition on it."""
    return df.where(~should_skip(match, exclude, Inputs.of(df, now))["skip"])
