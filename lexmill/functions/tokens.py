"""Code-aware tokens as column expressions (no Python in the tasks)."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shared by Spark and DuckDB: no look-around, explicit Unicode classes.
CAMEL = r"(\p{Ll})(\p{Lu})"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}_\s\p{Z}\x0B]"
SYMBOL = r"^[^\p{L}\p{N}]$"

#: Words for operators and signs, and tokens without a meaning of their own.
OPERATOR_WORDS = {
    "->": "ARROW", "=>": "FATARROW", "::": "DOUBLECOLON", "++": "INCREMENT", "--": "DECREMENT", "===": "STRICTEQUAL",
    "!==": "STRICTNOTEQUAL", "==": "EQUAL", "!=": "NOTEQUAL", "$": "DOLLAR", "@": "AT", "#": "HASH", "&": "AMP", "|": "PIPE",
    "?": "QUESTION", "!": "EXCLAIM", "*": "STAR", "+": "PLUS", "(": "LPAREN", ")": "RPAREN", "[": "LBRACKET", "]": "RBRACKET",
    "{": "LBRACE", "}": "RBRACE", "@param": "AT_param", "@return": "AT_return", "@var": "AT_var", "@throws": "AT_throws",
    "...": "SPREAD", "??": "NULLCOALESCE", "?->": "NULLSAFE",
}
NOISE = (";", ",", ".", ":", "=")
JOINERS = ("_", "-", ".", "\\", "/")
#: Words of which no lower form is added.
NO_LOWER = ("dollar", "arrow", "at")


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits, cut at lower-to-upper changes, and single signs; underscores vanish."""
    return F.regexp_extract_all(F.regexp_replace(text, F.lit(CAMEL), F.lit("$1 $2")), F.lit(TOKEN), F.lit(0))


def encode_symbols(tokens: Column) -> Column:
    """A sign becomes T<utf8 hex>K; a double quote counts as a single one."""
    plain = lambda t: F.when(t == '"', F.lit("'")).otherwise(t)
    return F.transform(tokens, lambda t: F.when(t.rlike(SYMBOL), F.concat(F.lit("T"), F.lower(F.hex(F.encode(plain(t), "UTF-8"))), F.lit("K"))).otherwise(t))


@cache
def _folds() -> tuple[str, str]:
    """Accented letters of Latin, Greek and Cyrillic and their base letters, from Unicode decompositions."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        base = unicodedata.normalize("NFD", letter)
        plain = "".join(c for c in base if not unicodedata.combining(c))
        if len(base) > 1 and len(plain) == 1:
            pairs.append((letter, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), *_folds())


def index_tokens(text: Column) -> Column:
    """What the index keeps of a text: raw tokens, signs encoded, folded."""
    return F.transform(encode_symbols(raw_tokens(text)), fold)


def split_identifier(name: Column) -> Column:
    """Struct of the trimmed name, its distinct tokens in order (joiners dropped) and the searchable string."""
    name = F.trim(name)
    parts = F.regexp_extract_all(F.regexp_replace(name, F.lit(CAMEL), F.lit("$1 $2")), F.lit(TOKEN), F.lit(0))
    parts = F.array_distinct(F.filter(parts, lambda t: ~t.isin(*JOINERS)))
    both = F.flatten(F.transform(parts, lambda t: F.array(t, F.lower(t))))
    searchable = F.array_join(F.array_distinct(F.concat(F.array(name), both, F.array(F.lower(name)))), " ")
    return F.struct(name.alias("original"), parts.alias("tokens"), searchable.alias("searchable"))


def operator_words(tokens: Column, hex_rest: bool = False) -> Column:
    """Signs become words, noise goes, other signs go or become hexadecimal; distinct, in order."""
    words = F.create_map(*[F.lit(x) for pair in OPERATOR_WORDS.items() for x in pair])
    hexed = lambda t: F.regexp_replace(F.hex(F.encode(t, "UTF-8")), F.lit("(..)"), F.lit("x$1"))
    named = lambda t: F.coalesce(
        F.try_element_at(words, t),
        F.when(t.rlike("^[a-zA-Z0-9_]+$"), t),
        hexed(t) if hex_rest else F.when(t.rlike(r"[^\x00-\x7F]"), t),
    )
    useful = F.filter(tokens, lambda t: (F.trim(t) != "") & ~t.isin(*NOISE))
    return F.array_distinct(F.array_compact(F.transform(useful, named)))


def significant(token: Column) -> Column:
    """Whether a token deserves an index entry."""
    single = (F.length(token) == 1) & ~token.rlike("^[A-Za-z0-9]$") & ~token.isin(*OPERATOR_WORDS)
    return (F.trim(token) != "") & ~token.isin(*NOISE) & ~single


def _with_lower(tokens: Column) -> Column:
    pairs = F.flatten(F.transform(tokens, lambda t: F.when(F.lower(t).isin(*NO_LOWER), F.array(t)).otherwise(F.array(t, F.lower(t)))))
    return F.array_distinct(pairs)


def identifier_words(name: Column) -> Column:
    """The searchable words of one identifier."""
    split = split_identifier(name)
    return _with_lower(operator_words(F.concat(F.array(split["original"]), split["tokens"])))


def snippet_words(code: Column) -> Column:
    """The searchable words of a code snippet, joined by spaces."""
    found = F.regexp_extract_all(code, F.lit(r"[a-zA-Z_$@#][a-zA-Z0-9_]*|->|=>|::|[^\s]+"), F.lit(0))
    return F.array_join(F.array_distinct(F.flatten(F.transform(found, identifier_words))), " ")


def identifiers_in(code: Column) -> Column:
    """All identifiers of a snippet with their tokens and lower forms, joined by spaces."""
    found = F.regexp_extract_all(code, F.lit(r"[a-zA-Z_\x{80}-\x{FF}][a-zA-Z0-9_\x{80}-\x{FF}]*"), F.lit(0))
    each = F.array_distinct(F.flatten(F.transform(found, lambda x: F.concat(F.array(x), split_identifier(x)["tokens"]))))
    return F.array_join(F.array_distinct(F.flatten(F.transform(each, lambda t: F.array(t, F.lower(t))))), " ")


def encode_odd(text: Column) -> Column:
    """Characters outside ASCII that are neither letter nor digit become x<HEX>."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"[^\x00-\x7F]") & c.rlike(r"[^\p{L}\p{N}]"), F.concat(F.lit("x"), F.hex(F.encode(c, "UTF-8")))).otherwise(c)), "")


def with_searchable(entities: DataFrame) -> DataFrame:
    """Adds name_words and, where there is a signature, signature_words."""
    words = F.when(F.col("signature") != "", snippet_words(F.col("signature"))).otherwise("")
    return entities.withColumns({"name_words": F.array_join(identifier_words(F.col("name")), " "), "signature_words": F.coalesce(words, F.lit(""))})


def detokenise(text: Column, before: str = "", after: str = "") -> Column:
    """Readable text of index tokens: codes become signs without spaces around them, camel case is joined again;
    `before` and `after` are marks around hits that stay, and touching pairs of marks become one."""
    edge = "\x01"
    marks = [F.lit(x) for x in (before, after)]
    pattern = "^(" + re.escape(before) + ")?T((?:[0-9a-f]{2})+)K(" + re.escape(after) + ")?$"
    sign = lambda t: F.decode(F.unhex(F.regexp_extract(t, pattern, 2)), "UTF-8")
    decoded = F.transform(F.split(text, " "), lambda t: F.when(t.rlike(pattern), F.concat(F.lit(edge), F.regexp_extract(t, pattern, 1), sign(t), F.regexp_extract(t, pattern, 3), F.lit(edge))).otherwise(t))
    out = F.regexp_replace(F.array_join(decoded, " "), F.lit(f" ?{edge}+ ?"), F.lit(""))
    if before and after:
        out = F.replace(out, F.concat(*reversed(marks)), F.lit(""))
    return F.regexp_replace(out, F.lit(r"(?<=\p{Ll}) (?=\p{Lu}\p{Ll})"), F.lit(""))
