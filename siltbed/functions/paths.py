"""Paths, namespaces, globs and the display of times, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespace(parts: Column) -> Column:
    """Colon-joined components with a colon at the end; the root is a lone colon."""
    return F.concat(F.array_join(parts, ":"), F.lit(":"))


def object_key(parts: Column, path: Column) -> Column:
    return F.concat(namespace(parts), trimmed(path))


def trimmed(path: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(path, r"(?U)^\s+|\s+$", "")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(path: Column) -> Column:
    """All proper prefixes of a path at slashes, without the empty one."""
    parts = F.split(path, "/", -1)
    return F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def glob_to_regex(glob: str) -> str:
    """`*` and `?` match slashes too; `[..]` with `!` or `^` to negate; `{a,b}`; backslash takes the next as it is."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while glob[i + 1 : i + 2] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            inner = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' * negated}{inner}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in {glob!r}")
    return f"(?s)^{''.join(out)}$"


def glob_filter(path: Column, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Column:
    """Any include glob (all paths if there is none), and no exclude glob."""
    hits = lambda globs: reduce(lambda a, b: a | b, [path.rlike(glob_to_regex(g)) for g in globs])
    include, exclude = list(include), list(exclude)
    keep = hits(include) if include else F.lit(True)
    return keep & ~hits(exclude) if exclude else keep


def rfc2822(ts: Column, tz_offset_sec: Column | None = None) -> Column:
    """A UTC timestamp, shown at an offset in seconds from UTC. The session time zone must be UTC."""
    if tz_offset_sec is None:
        return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss Z")
    off = F.abs(tz_offset_sec)
    sign = F.when(tz_offset_sec < 0, "-").otherwise("+")
    zone = F.concat(sign, F.lpad(F.floor(off / 3600).cast("string"), 2, "0"), F.lpad(F.floor(off % 3600 / 60).cast("string"), 2, "0"))
    return F.concat(F.date_format(F.timestamp_seconds(F.unix_seconds(ts) + tz_offset_sec), "EEE, dd MMM yyyy HH:mm:ss "), zone)
