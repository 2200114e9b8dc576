"""Names, references, sizes, hashes, colours and other text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_U32 = 0xFFFFFFFF


def local_name(tag: Column) -> Column:
    """``{uri}name`` without its namespace."""
    return F.substring_index(tag, "}", -1)


def reference(uri: Column, rule: str = "require") -> Column:
    """An id from ``#id``: ``require`` (null without #), ``strip`` (all leading #) or ``prefix`` (one # if there)."""
    if rule == "require":
        return F.when(uri.startswith("#"), F.substring(uri, 2, 1 << 30))
    if rule == "strip":
        return F.ltrim(uri, F.lit("#"))
    return F.regexp_replace(uri, "^#", "")


def bytes_text(n: Column) -> Column:
    """Size with two decimals, B to TB, half to even on ties; the sign is kept for differences."""
    size, out = F.abs(n.cast("double")), None
    for power, unit in ((1024.0, "B"), (1024.0**2, "KB"), (1024.0**3, "MB"), (1024.0**4, "GB")):
        said = F.concat(F.format_string("%.2f", F.bround(n / (power / 1024), 2)), F.lit(unit))
        out = F.when(size < power, said) if out is None else out.when(size < power, said)
    return out.otherwise(F.concat(F.format_string("%.2f", F.bround(n / 1024.0**4, 2)), F.lit("TB")))


def bytes_short(n: Column) -> Column:
    """Size with one decimal, B to GB, ties up; ``n/a`` for null."""
    out = F.when(n.isNull(), F.lit("n/a"))
    for power, unit in ((1024.0, "B"), (1024.0**2, "KB"), (1024.0**3, "MB"), (float("inf"), "GB")):
        scale = 1024.0**3 if unit == "GB" else power / 1024
        out = out.when(n < power, F.concat(F.format_string("%.1f", F.round(n / scale, 1)), F.lit(f" {unit}")))
    return out


def kib(n: Column) -> Column:
    """KiB with one decimal."""
    return F.concat(F.format_string("%.1f", F.round(n / 1024.0, 1)), F.lit(" KiB"))


def _mul32(a: Column, b: int) -> Column:
    """Low 32 bits of a product: the constant is split so that no step leaves 63 bits."""
    low, high = b & 0xFFFF, b >> 16
    part = F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)
    return (a * low + part).bitwiseAND(F.lit(_U32))


def _codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def mixed_hash(s: Column) -> Column:
    """FNV-1a over character codes, then the 32-bit avalanche; code points up to 0xFFFF."""
    h = F.aggregate(_codes(s), F.lit(0x811C9DC5), lambda h, c: _mul32(h.bitwiseXOR(c), 0x01000193))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 16))
    h = _mul32(h, 0x85EBCA6B)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = _mul32(h, 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def mixed_hue(s: Column) -> Column:
    """Hue of a value's colour; null where the value is empty."""
    return F.when(s != "", mixed_hash(s) % 360)


def style_hue(doc: Column, path: str) -> Column:
    """Hue by the value at a path of a feature's JSON: no style at all for a blank path, no colour for an empty value."""
    return mixed_hue(dot_get(doc, path)) if path.strip() else F.lit(None).cast("long")


def simple_hash(s: Column) -> Column:
    """31-multiplier string hash as a signed 32-bit number."""
    h = F.aggregate(_codes(s), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(_U32)))
    return F.when(h > 0x7FFFFFFF, h - (_U32 + 1)).otherwise(h)


def simple_hue(s: Column) -> Column:
    return F.abs(simple_hash(s)) % 360


def log_hue(value: Column, low: Column, high: Column) -> Column:
    """Hue from 240 (low) to 0 (high) on a log scale; null stays null (shown grey)."""
    bottom, top = F.ln(low + 1), F.ln(high + 1)
    share = F.when(top > bottom, (F.ln(value + 1) - bottom) / (top - bottom)).otherwise(0.0)
    return F.when(value.isNotNull(), 240 - 240 * share)


def legend(low: Column, high: Column) -> Column:
    """Five values at equal steps of the log scale."""
    bottom, top = F.ln(low + 1), F.ln(high + 1)
    return F.transform(F.array(*(F.lit(t) for t in (0.0, 0.25, 0.5, 0.75, 1.0))), lambda t: F.exp(bottom + t * (top - bottom)) - 1)


def hsv_rgb(h: Column, s: Column, v: Column) -> Column:
    """Red, green, blue (0 to 255, truncated) of hue, saturation and value (0 to 1)."""
    six = h * 6
    i, f = F.floor(six), six - F.floor(six)
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *six_of: F.element_at(F.array(*six_of), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    return F.transform(F.array(pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)), lambda c: F.floor(c * 255).cast("int"))


def html_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def template_escape(s: Column) -> Column:
    """Backslashes and backticks escaped for a script's template text."""
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))


def padding(n: Column) -> Column:
    """Bytes that fill up to a multiple of four."""
    return F.pmod(4 - n % 4, F.lit(4))


def floats(s: Column) -> Column:
    """Numbers of a white-space separated list; an empty list for blank text."""
    return F.transform(F.filter(F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " "), lambda x: x != ""), lambda x: x.cast("double"))


def frame_name(line: Column) -> Column:
    """Function of a stack line: after the last backtick, before + and (."""
    return F.substring_index(F.substring_index(F.substring_index(line, "`", -1), "+", 1), "(", 1)


def branch_name(ref: Column) -> Column:
    return F.replace(ref, F.lit("refs/remotes/origin/"), F.lit(""))


def node_label(action: Column, subgraph: Column) -> Column:
    """A node's action, else its subgraph's last eight characters, ``?`` where unknown."""
    return F.coalesce(F.nullif(action, F.lit("")), F.concat(F.lit("subGraph:"), F.right(F.coalesce(subgraph, F.lit("?")), F.lit(8))))


def palette(index: Column, colours: list[str]) -> Column:
    """Colour by position, repeating."""
    return F.element_at(F.array(*(F.lit(c) for c in colours)), (index % len(colours) + 1).cast("int"))


def geometry_family(kind: Column) -> Column:
    return F.when(kind.isin("Point", "MultiPoint"), "point").when(kind.isin("LineString", "MultiLineString"), "line").otherwise("other")


def dot_get(doc: Column, path: str) -> Column:
    """Value of a dotted path with ``[n]`` steps in JSON text; missing and falsy values become ``''``."""
    value = F.get_json_object(doc, "$" + "".join(p if p.startswith("[") else f".{p}" for p in path.lstrip(".").replace("[", ".[").split(".") if p))
    falsy = value.isNull() | value.isin("", "false", "0", "0.0", "-0", "-0.0", "[]", "{}", "null")
    return F.when(falsy, F.lit("")).otherwise(value)


def stamp(ts: Column) -> Column:
    """Date and time of a report's heading."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
