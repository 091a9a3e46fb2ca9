"""Draws and keys that depend on row content only, never on partition layout.

``rand(seed)`` changes when a table is repartitioned or a task is retried;
these draws do not, so lost executors and other cluster sizes give equal rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_52 = float(2**52)


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(str(part))).cast("string")


def digest(*parts) -> Column:
    """32 hex digits of the parts joined by '|'. Python values become literals."""
    return F.md5(F.concat_ws("|", *[_text(p) for p in parts]))


def hex_number(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("long")


def u01(*parts) -> Column:
    """Uniform draw in [0, 1) from the first 52 bits of the digest."""
    return hex_number(F.substring(digest(*parts), 1, 13)).cast("double") / F.lit(TWO_52)


def normal01(seed, feature, row_id) -> Column:
    """Standard normal draw (Box-Muller on two salted uniforms)."""
    first = u01(seed, f"{feature}:n1", row_id)
    second = u01(seed, f"{feature}:n2", row_id)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - first)) * F.cos(F.lit(2.0 * math.pi) * second)


def cache_key(*parts) -> Column:
    """First 24 hex digits of SHA-256 over the parts; a missing part counts as ''.

    The parts are joined by the unit separator (char 31), which does not occur
    in names or descriptions, so ('a|b', 'c') and ('a', 'b|c') stay apart.
    """
    texts = [F.coalesce(_text(p) if p is not None else F.lit(""), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws("\x1f", *texts), 256), 1, 24)


def packed(key: Column) -> Column:
    """A key as bytes, hex digits in half their length; any text can be told from its bytes, see ``unpacked``."""
    is_hex = F.unhex(key).isNotNull() & (F.length(key) % 2 == 0) & (F.lower(key) == key)
    return F.when(is_hex, F.concat(F.lit(b"\x01"), F.unhex(key))).otherwise(F.concat(F.lit(b"\x00"), F.encode(key, "UTF-8")))


def unpacked(key: Column) -> Column:
    """The text that ``packed`` made these bytes of."""
    was_hex, rest = F.substring(key, 1, 1) == F.lit(b"\x01"), F.substring(key, 2, 2**31 - 1)
    return F.when(was_hex, F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))
