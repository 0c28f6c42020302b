"""Text keys, names, paths and references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key(c: Column | str) -> Column:
    """Upper case, ``&`` as AND, everything but letters and digits a single space, trimmed."""
    spelled = F.replace(F.upper(_col(c)), F.lit("&"), F.lit(" AND "))
    return F.trim(F.regexp_replace(spelled, "[^A-Z0-9]+", " "))


def slug(c: Column | str, fallback: str = "item") -> Column:
    """Runs of other characters than letters, digits, dot, underscore and dash become one dash; dashes at the
    ends go; what is then empty, or null, is the fallback."""
    dashed = F.regexp_replace(_col(c), "[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("")), F.lit(fallback))


def path_parts(c: Column | str) -> Column:
    """Parts of a path without empty ones and ``.``."""
    return F.filter(F.split(F.replace(_col(c), F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))


def safe_path(c: Column | str) -> Column:
    """The path put together from its parts. A part ``..`` raises."""
    parts = path_parts(c)
    return F.when(F.array_contains(parts, ".."), F.raise_error(F.concat(F.lit("path leaves its root: "), _col(c)))).otherwise(F.array_join(parts, "/"))


def join_path(*parts: Column | str) -> Column:
    return safe_path(F.concat_ws("/", *[_col(p) for p in parts]))


def location(c: Column | str) -> tuple[Column, Column]:
    """``owner/name/prefix...`` to (repository, prefix)."""
    parts = path_parts(c)
    return F.array_join(F.slice(parts, 1, 2), "/"), F.array_join(F.slice(parts, F.lit(3), F.greatest(F.lit(0), F.size(parts) - 2)), "/")


def reference(c: Column | str) -> tuple[Column, Column]:
    """``archive::member`` to its two sides; the member of a reference without ``::`` is null."""
    c = _col(c)
    return F.split_part(c, F.lit("::"), F.lit(1)), F.nullif(F.split_part(c, F.lit("::"), F.lit(2)), F.lit(""))


def safe_member(c: Column | str) -> Column:
    """Whether a member name is relative and stays below its root."""
    c = _col(c)
    return F.coalesce(~c.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)|\\") & (c != ""), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regular expression: ``*`` crosses ``/`` and ``?`` is one character."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else "\\" + ch if ch in r"\.+()|^${}[]" else ch)
    return "^" + "".join(out) + "$"


def included(c: Column | str, allow: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """A path that some ``allow`` glob takes (all, if none is given) and no ``ignore`` glob does."""
    c = _col(c)
    taken = F.lit(True)
    if allow:
        taken = c.rlike("|".join(map(glob_regex, allow)))
    if ignore:
        taken = taken & ~c.rlike("|".join(map(glob_regex, ignore)))
    return taken


def ranks(c: Column | str) -> tuple[Column, Column]:
    """The two rank labels ``<rank>-<rank>-`` that begin a file name, in lower case; null where missing."""
    pattern = r"^([A-Za-z]+)-([A-Za-z]+)-"
    return tuple(F.nullif(F.lower(F.regexp_extract(_col(c), pattern, k)), F.lit("")) for k in (1, 2))


def suffix_number(c: Column | str) -> Column:
    """The number that ends a file stem, for numeric order; null if there is none."""
    return F.nullif(F.regexp_extract(_col(c), r"(\d+)(?:\.[^./]*)?$", 1), F.lit("")).cast("long")


def numbered(c: Column | str, width: int = 6) -> Column:
    """A zero-padded number; the sign of a negative one comes first."""
    c = _col(c).cast("long")
    return F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.lpad(F.abs(c).cast("string"), width, "0"))


def clock(seconds: Column | str) -> Column:
    """Seconds as ``m:ss.mmm``."""
    ms = F.round(_col(seconds) * 1000).cast("long")
    return F.format_string("%d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def csv_field(c: Column | str) -> Column:
    """A CSV field: quoted, with quotes doubled, where it holds a quote, comma or line break."""
    c = F.coalesce(_col(c).cast("string"), F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def names_found(c: Column | str, names: dict[str, str], aliases: dict[str, str]) -> Column:
    """Names in a text of parts joined by ``+``: tags in brackets are dropped, an alias wins, else the longest
    name that stands in the part as whole words."""
    order = sorted(names, key=lambda n: (-len(n), n))

    def one(part: Column) -> Column:
        k = key(F.regexp_replace(part, r"\[[^\]]*\]|\([^)]*\)", " "))
        found = F.lit(None).cast("string")
        for name in reversed(order):
            found = F.when(F.contains(F.concat(F.lit(" "), k, F.lit(" ")), F.lit(f" {name} ")), F.lit(names[name])).otherwise(found)
        for alias, name in aliases.items():
            found = F.when(k == alias, F.lit(name)).otherwise(found)
        return found

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(_col(c), r"\+"), one))))


def stage_code(c: Column | str) -> Column:
    """The code in brackets that ends a file's stem, in upper case; null where there is none."""
    return F.nullif(F.upper(F.regexp_extract(_col(c), r"\(([A-Za-z0-9]+)\)\s*(?:\.[^./]*)?$", 1)), F.lit(""))


def utc_stamp(c: Column | str) -> Column:
    """A time as ISO 8601 text in UTC with milliseconds; a time without a zone is taken as UTC."""
    return F.concat(F.date_format(_col(c).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def transient(message: Column | str) -> Column:
    """Whether an error text tells of a passing failure: a timeout, a reset, or a status that may pass."""
    return F.coalesce(F.lower(_col(message)).rlike(r"timeout|timed out|temporar|connection (reset|refused|aborted)|unavailable|too many requests|\b(408|409|425|429|500|502|503|504)\b"), F.lit(False))


def scrubbed(value, mask: str = "***"):
    """A nested document with the values of keys that name a key, token, secret or password masked; all values
    of ``env`` are. It is for documents on the driver; columns use :func:`masked_map`."""
    if isinstance(value, dict):
        return {k: mask if _sensitive(k) else {n: mask for n in v} if k == "env" and isinstance(v, dict) else scrubbed(v, mask) for k, v in value.items()}
    return [scrubbed(v, mask) for v in value] if isinstance(value, list) else value


def _sensitive(name: str) -> bool:
    return any(word in str(name).lower() for word in ("key", "token", "secret", "password"))


def masked_map(c: Column | str, mask: str = "***") -> Column:
    return F.transform_values(_col(c), lambda k, v: F.when(F.lower(k).rlike("key|token|secret|password"), F.lit(mask)).otherwise(v))


def version_at_least(c: Column | str, target: str) -> Column:
    """Dotted versions by their first three numbers; missing parts, and null, are 0."""
    parts = F.split(F.coalesce(_col(c).cast("string"), F.lit("0")), r"\.")
    own = [F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), F.lit(0)) for k in (1, 2, 3)]
    want = [int(x) for x in (target.split(".") + ["0", "0"])[:3]]
    return F.struct(*[x.alias(f"v{k}") for k, x in enumerate(own)]) >= F.struct(*[F.lit(x).alias(f"v{k}") for k, x in enumerate(want)])
