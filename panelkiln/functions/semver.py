"""Version ranges as package managers write them: comparison, membership, best match."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = re.compile(r"^[v=\s]*(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$")


@lru_cache(maxsize=100_000)
def parse(version: str) -> tuple | None:
    """A key that sorts by precedence: pre-releases come before their release, numbers before words."""
    m = _VERSION.match(version.strip())
    if not m or any(p is None or p in "xX*" for p in m.groups()[:3]):
        return None
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else ((2, 0, ""),)
    return (int(m[1]), int(m[2]), int(m[3]), pre)


_LAST = ((2, 0, ""),)


def _bounds(token: str) -> list[tuple[str, tuple]] | None:
    """Comparisons that a token of a range stands for."""
    m = re.match(r"^(\^|~>?|>=|<=|>|<|=)?\s*(.*)$", token)
    op, rest = m[1] or "", m[2].strip()
    if rest in ("", "*", "x", "X", "latest"):
        return []
    v = _VERSION.match(rest)
    if not v:
        return None
    given = [int(p) for p in v.groups()[:3] if p is not None and p not in "xX*"]
    wild = [p for p in v.groups()[:3] if p is not None and p in "xX*"]
    if not given:
        return []
    full = (*given, *[0] * (3 - len(given)))
    low = (*full, parse(rest)[3] if v[4] and len(given) == 3 else _LAST)
    up = lambda k: (*full[:k], full[k] + 1, *[0] * (2 - k), ((0, -1, ""),))  # noqa: E731  just below the next version
    if op == "^":
        k = next((i for i, x in enumerate(given) if x), len(given) - 1)
        return [(">=", low), ("<", up(k))]
    if op in ("~", "~>"):
        return [(">=", low), ("<", up(min(1, len(given) - 1)))]
    if op in ("", "=") and (wild or len(given) < 3):
        return [(">=", low), ("<", up(len(given) - 1))]
    if op == "<=" and len(given) < 3:
        return [("<", up(len(given) - 1))]
    if op == ">" and len(given) < 3:
        return [(">=", (*up(len(given) - 1)[:3], _LAST))]
    return [(op or "=", low)]


@lru_cache(maxsize=100_000)
def compiled(spec: str) -> tuple[tuple[tuple[str, tuple], ...], ...]:
    """OR of ANDs of comparisons."""
    out = []
    for part in spec.split("||"):
        part = part.strip()
        if m := re.match(r"^(\S+)\s+-\s+(\S+)$", part):
            tokens = [f">={m[1]}", f"<={m[2]}"]
        else:
            tokens = [t for t in re.split(r"[\s,]+", re.sub(r"(\^|~>?|>=|<=|>|<|=)\s+", r"\1", part)) if t] or ["*"]
        bounds = [_bounds(t) for t in tokens]
        if all(b is not None for b in bounds):
            out.append(tuple(c for b in bounds for c in b))
    return tuple(out)


def satisfies(version: str, spec: str) -> bool:
    v = parse(version)
    test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "=": lambda a, b: a == b}
    return v is not None and any(all(test[op](v, b) for op, b in ands) for ands in compiled(spec))


def best(versions, spec: str) -> str | None:
    """The newest version within the range."""
    fit = [v for v in versions if v is not None and satisfies(v, spec)]
    return max(fit, key=parse) if fit else None


@F.pandas_udf(T.BooleanType())
def version_satisfies(version: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or s is None else satisfies(v, s) for v, s in zip(version, spec, strict=True)])


@F.pandas_udf(T.StringType())
def best_version(versions: pd.Series, spec: pd.Series) -> pd.Series:
    return pd.Series([None if vs is None or s is None else best(vs, s) for vs, s in zip(versions, spec, strict=True)])


def sort_key(k: tuple) -> str:
    """A text that sorts as the keys of ``parse`` do."""
    # '!' sorts before all that a version's parts can hold, '-' before digits: a part of -1 is below all others.
    return ".".join(f"{x:010d}" for x in k[:3]) + "!" + "!".join(f"{a}{b:010d}{c}" if b >= 0 else f"{a}-" for a, b, c in k[3]) + "!"


def intervals(spec: str) -> list[tuple[str | None, bool, str | None, bool]]:
    """A range as intervals of sort keys: (low, whether itself within, high, whether itself within), None for no bound."""
    out = []
    for ands in compiled(spec):
        low, high = (None, False), (None, False)
        for op, v in ands:
            # Of equal bounds the one that leaves its own value out is narrower.
            if op in (">=", ">", "=") and (low[0] is None or (v, op == ">") > (low[0], not low[1])):
                low = (v, op != ">")
            if op in ("<=", "<", "=") and (high[0] is None or (v, op != "<") < (high[0], high[1])):
                high = (v, op != "<")
        out.append((sort_key(low[0]) if low[0] else None, low[1], sort_key(high[0]) if high[0] else None, high[1]))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("low", "string").add("low_in", "boolean").add("high", "string").add("high_in", "boolean")))
def spec_intervals(spec: pd.Series) -> pd.Series:
    return spec.map(lambda s: [dict(zip(("low", "low_in", "high", "high_in"), i, strict=True)) for i in intervals(s)] if s is not None else None)


@F.pandas_udf(T.StringType())
def version_key(version: pd.Series) -> pd.Series:
    """A string that sorts as the versions do; NULL if it is none."""

    def key(v: str | None) -> str | None:
        k = parse(v) if v is not None else None
        return sort_key(k) if k is not None else None

    return version.map(key)
