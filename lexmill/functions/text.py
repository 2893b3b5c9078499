"""Scalar functions on paths, docblocks, type expressions and ages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, F.lit("/[^/]*$"), F.lit(""))


def extension(path: Column) -> Column:
    """Lower-case extension of the base name, or the empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def ancestors(path: Column) -> Column:
    """All directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def age_penalty(filetime: Column, now: int) -> Column:
    """4 a^1.5 / (1 + a^1.5) for an age of a years, 0 for the future."""
    years = F.greatest(F.lit(0.0), (F.lit(float(now)) - filetime) / (365.0 * DAY))
    grown = F.pow(years, F.lit(1.5))
    return F.lit(4.0) * grown / (F.lit(1.0) + grown)


def humanise_age(seconds: Column) -> Column:
    steps = ((60, 1, "s"), (3600, 60, "m"), (DAY, 3600, "h"), (7 * DAY, DAY, "d"), (30 * DAY, 7 * DAY, "w"))
    out = F.concat(F.floor(seconds / (30 * DAY)).cast("string"), F.lit("mo"))
    for limit, unit, sign in reversed(steps):
        out = F.when(seconds < limit, F.concat(F.floor(seconds / unit).cast("string"), F.lit(sign))).otherwise(out)
    return out


def humanise_bytes(n: Column) -> Column:
    """One decimal at most, in steps of 1024 up to GB: 512B, 1.5KB, 2GB."""
    shown = lambda x, sign: F.concat(F.regexp_replace(F.format_string("%.1f", F.round(x, 1)), r"\.0$", ""), F.lit(sign))
    out = shown(n / 1024**3, "GB")
    for power, sign in ((2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024 ** (power + 1), shown(n / 1024**power, sign)).otherwise(out)
    return out


def doc_lines(doc: Column) -> Column:
    """Lines of a docblock without comment marks."""
    inner = F.regexp_replace(F.regexp_replace(doc, F.lit(r"^\s*/\*+"), F.lit("")), F.lit(r"\*+/\s*$"), F.lit(""))
    return F.transform(F.split(inner, "\n"), lambda x: F.trim(F.regexp_replace(x, F.lit(r"^\s*\*\s?"), F.lit(""))))


def doc_summary(doc: Column) -> Column:
    """First line that is neither empty nor a tag; the empty string if there is none."""
    return F.coalesce(F.get(F.filter(doc_lines(doc), lambda x: (x != "") & ~x.startswith("@")), 0), F.lit(""))


def doc_description(doc: Column) -> Column:
    """The text between the summary and the first tag."""
    lines = doc_lines(doc)
    tag = F.array_position(F.transform(lines, lambda x: x.startswith("@")), F.lit(True))
    lines = F.when(tag > 0, F.slice(lines, F.lit(1), (tag - 1).cast("int"))).otherwise(lines)
    first = F.array_position(F.transform(lines, lambda x: x != ""), F.lit(True)).cast("int")
    rest = F.when(first > 0, F.slice(lines, first + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.trim(F.array_join(F.filter(rest, lambda x: x != ""), "\n"))


def visibility(name: Column) -> Column:
    dunder = name.startswith("__") & name.endswith("__")
    return F.when(name.startswith("__") & ~dunder, "private").when(name.startswith("_"), "protected").otherwise("public")


def type_matches(type_expr: Column, wanted: Column) -> Column:
    """Whether a branch of a type expression is `wanted`, by its full or short name; T|null is ?T."""
    branches = F.filter(F.split(type_expr, r"[|&]"), lambda t: t != "")
    named = F.transform(branches, lambda t: F.regexp_replace(t, F.lit(r"^\??\\?"), F.lit("")))
    nullable = (F.size(named) == 2) & F.exists(named, lambda t: t == "null")
    named = F.when(nullable, F.filter(named, lambda t: t != "null")).otherwise(named)
    return F.exists(named, lambda t: (t == wanted) | (F.substring_index(t, "\\", -1) == wanted))


def format_type(type_expr: Column) -> Column:
    return F.coalesce(F.when(type_expr == "", F.lit("mixed")).otherwise(type_expr), F.lit("mixed"))


def format_parameter(type_expr: Column, name: Column, variadic: Column, by_ref: Column, default: Column) -> Column:
    """`type ...&$name = default`; a null type or default is left out, an unreadable default is `?`."""
    sign = lambda on, text: F.when(on, F.lit(text)).otherwise(F.lit(""))
    return F.concat(F.coalesce(F.concat(type_expr, F.lit(" ")), F.lit("")), sign(variadic, "..."), sign(by_ref, "&"), F.lit("$"), name, F.coalesce(F.concat(F.lit(" = "), default), F.lit("")))


def preview(value: Column) -> Column:
    return F.when(F.length(value) > 50, F.concat(F.left(value, F.lit(47)), F.lit("..."))).otherwise(value)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, F.lit(r"\s+"), F.lit(" ")))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def cap_body(text: Column, limit: int = 100_000) -> Column:
    return F.substring(text, 1, limit)


#: Interpreters by the pattern that names them in a `#!` line, first match wins.
INTERPRETERS = (("php", "php"), ("python[0-9]*", "python"), ("node", "javascript"), ("(bash|sh|zsh)$", "bash"), ("ruby", "ruby"), ("perl", "perl"))


def script_language(text: Column) -> Column:
    """Language of a `#!` script, `script` if the interpreter is unknown, null without such a line."""
    line = F.substring_index(text, "\n", 1)
    out = F.lit("script")
    for pattern, name in reversed(INTERPRETERS):
        out = F.when(line.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(text.startswith("#!"), out)
