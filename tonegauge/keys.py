"""Deterministic per-row randomness and content keys.

``u(parts...)`` maps key columns to a uniform in [0, 1).  It never depends on partitioning or
task order (unlike ``rand()``), so reruns, retries after executor loss and other engines give
the same draws.  Two backends:

* ``md5``: first 52 bits of md5 over ``'|'``-joined parts (exact in a double).  DuckDB computes
  the same number from the first 13 hex digits (see :func:`u_sql`).
* ``xxhash``: low 52 bits of Spark's ``xxhash64``; an order of magnitude cheaper, Spark only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0
TWO_52 = 4503599627370496.0


def _as_col(p) -> Column:
    if isinstance(p, Column):
        return p.cast("string")
    if isinstance(p, str) and p.startswith("col:"):
        return F.col(p[4:]).cast("string")
    return F.lit(str(p))


def u(*parts, backend: str = "md5") -> Column:
    """Uniform in [0, 1) from key parts (Columns, or literals turned into strings)."""
    if backend == "md5":
        h = F.conv(F.substring(F.md5(F.concat_ws("|", *[_as_col(p) for p in parts])), 1, 13), 16, 10)
        # try_cast: conv of 13 hex digits always parses; no ANSI error path in the generated code
        return h.try_cast("double") / F.lit(TWO_52)
    if backend == "xxhash":
        h = F.xxhash64(*[_as_col(p) for p in parts]).bitwiseAND(F.lit(0xFFFFFFFFFFFFF))
        return h.cast("double") / F.lit(TWO_52)
    raise ValueError(f"unknown backend {backend}")


def u_sql(*parts) -> str:
    """DuckDB twin of ``u(..., backend='md5')``.  Parts are SQL expressions or quoted literals."""
    rendered = []
    for p in parts:
        if isinstance(p, str) and p.startswith("col:"):
            rendered.append(f"CAST({p[4:]} AS VARCHAR)")
        else:
            rendered.append("'" + str(p).replace("'", "''") + "'")
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(rendered)})), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0::DOUBLE)"


def text_key(text: Column) -> Column:
    """Content address of a text (hex sha-256); group and join on this, not the text itself."""
    return F.sha2(text, 256)


def text_key_b64(text: Column) -> Column:
    """URL-safe base64 of the UTF-8 text, the key format of the original JSON cache."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")  # no MIME line breaks
    return F.translate(plain, "+/", "-_")


def u4(*parts) -> list[Column]:
    """Four independent uniforms from one md5 (its four 32-bit words); one hash per key."""
    h = F.md5(F.concat_ws("|", *[_as_col(p) for p in parts]))
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).try_cast("double") / F.lit(TWO_32) for k in range(4)]


def u4_sql(*parts) -> list[str]:
    rendered = []
    for p in parts:
        if isinstance(p, str) and p.startswith("col:"):
            rendered.append(f"CAST({p[4:]} AS VARCHAR)")
        else:
            rendered.append("'" + str(p).replace("'", "''") + "'")
    h = f"md5(concat_ws('|', {', '.join(rendered)}))"
    return [f"(CAST('0x' || substr({h}, {1 + 8 * k}, 8) AS UBIGINT) / 4294967296.0)" for k in range(4)]


def md5_hex(*parts) -> Column:
    """The md5 hex digest behind :func:`u4`; bind it to a column once, then slice uniforms."""
    return F.md5(F.concat_ws("|", *[_as_col(p) for p in parts]))


def u_from_hex(h: Column, k: int) -> Column:
    """The k-th (0-3) 32-bit uniform of an md5 hex digest (same value as ``u4(...)[k]``)."""
    return F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).try_cast("double") / F.lit(TWO_32)
