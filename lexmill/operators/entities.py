"""Entities of source files: whole files, Markdown sections, CSS rules, and Python, JavaScript and PHP declarations.

Markdown sections are column expressions. The other languages need a scan of each file, so small helpers run on
Arrow batches inside the tasks, one file a row; a file that a helper cannot read gives a row with `error` set.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexer
from lexmill.functions.text import INTERPRETERS, line_count
from lexmill.operators.files import route_extractor

SCHEMA = "filename string, type string, name string, namespace string, class_name string, signature string, docblock string, body string, line_start int, line_end int, language string, visibility string, error string"


def file_entities(files: DataFrame) -> DataFrame:
    return files.select("filename", F.lit("file").alias("type"), F.lit(1).alias("line_start"), line_count(F.col("content")).cast("int").alias("line_end"), F.col("content").alias("body"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """filename, signature (the raw heading line), name, body (heading included), line_start, line_end of `# ` sections.

    A running count over an array of line numbers cuts the sections without a shuffle.
    """
    lines = files.select("filename", F.split("content", "\n").alias("lines"))
    heads = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.element_at("lines", i).rlike(r"^#\s+."))
    cut = lines.select("filename", "lines", heads.alias("heads")).select("filename", "lines", "heads", F.posexplode("heads").alias("nth", "line_start"))
    end = F.when(F.col("nth") + 1 < F.size("heads"), F.get("heads", F.col("nth") + 1) - 1).otherwise(F.size("lines"))
    cut = cut.withColumn("line_end", end)
    body = F.array_join(F.slice("lines", F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    signature = F.element_at("lines", F.col("line_start"))
    return cut.select("filename", signature.alias("signature"), F.trim(F.regexp_replace(signature, r"^#\s+", "")).alias("name"), body.alias("body"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def css_entities(filename: str, text: str) -> Iterator[dict]:
    """Rules at any depth, each with what stands before its brace; a file without rules gives one row for the file."""
    code, lines = lexer.read(text, "css").code, _Lines(text)
    found = lexer.blocks(text, code)
    for head, opening, closing in found:
        selector = text[head:opening].strip(" \t\r\n\f")
        kind = next((k for start, k in (("@media", "css-media-query"), ("@keyframes", "css-keyframes"), ("@", "css-at-rule")) if selector.startswith(start)), "css-rule")
        yield _entity(type=kind, name=selector, signature=selector, body=text[opening + 1 : closing], line_start=lines.of(head + len(text[head:opening]) - len(text[head:opening].lstrip())), line_end=lines.of(closing), language="css")
    if not found:
        yield _entity(type="file", name=filename.rsplit("/", 1)[-1], signature="", body=text, line_start=1, line_end=text.count("\n") + 1, language="css")


def css_rules(files: DataFrame) -> DataFrame:
    """filename, selector, body, type of the rules at any depth; a file without rules gives one row for the file."""
    named = files.withColumn("filename", F.col("filename").cast("string"))
    return extract(named, "css").select(F.col("filename").cast(files.schema["filename"].dataType).alias("filename"), F.col("name").alias("selector"), "body", "type")


_DEF = re.compile(r"^(\s*)(?:async\s+)?(class|def)\s+(\w+)")


def _entity(**found) -> dict:
    return {"namespace": "", "class_name": "", "docblock": "", "visibility": "", "error": None} | found


def python_entities(filename: str, text: str) -> Iterator[dict]:
    """The file, classes at any indent, functions outside classes, and methods; functions in functions are skipped."""
    lines = text.split("\n")
    indents = [len(x) - len(x.lstrip()) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    yield _entity(type="file", name=filename.rsplit("/", 1)[-1], signature=filename, body=text, line_start=1, line_end=len(lines), language="python")

    def block_end(at: int, indent: int) -> int:
        return next((i for i in range(at + 1, len(lines)) if indents[i] is not None and indents[i] <= indent), len(lines))

    def docs(at: int) -> str:
        top = at
        while top and lines[top - 1].lstrip().startswith(("@", "#")) and not lines[top - 1].startswith("#!"):
            top -= 1
        above = "\n".join(x.strip() for x in lines[top:at])
        m = re.match(r'\s*[rRuUbB]*("""|\'\'\')(.*?)\1', "\n".join(lines[at + 1 : at + 101]), re.S)
        return (above + ("\n" if above and m else "") + (m[2].strip() if m else "")).strip()

    def scan(at: int, end: int, owner: str) -> Iterator[dict]:
        while at < end:
            m = _DEF.match(lines[at]) if indents[at] is not None else None
            if not m:
                at += 1
                continue
            stop, name = block_end(at, len(m[1])), m[3]
            hidden = "public" if not name.startswith("_") else "private" if name.startswith("__") and not name.endswith("__") else "protected"
            kind = "class" if m[2] == "class" else "method" if owner else "function"
            yield _entity(type=kind, name=name, class_name=owner if kind != "class" else "", signature=lines[at].strip().rstrip(":"), docblock=docs(at), body="\n".join(lines[at:stop]), line_start=at + 1, line_end=stop, language="python", visibility=hidden)
            if kind == "class":
                yield from scan(at + 1, stop, name)
            at = stop

    yield from scan(0, len(lines), "")


class _Lines:
    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def of(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1


def brace_end(text: str, opening: int, language: str = "javascript") -> int:
    """Place behind the brace that closes the one at `opening`; the end of the text if there is none."""
    code = lexer.read(text, language).code
    return next((c + 1 for _, o, c in lexer.blocks(text, code) if o == opening), len(text))


#: Words that may stand before a declaration, and words before brackets that declare no method.
_MODIFIERS = {
    "javascript": frozenset("export default abstract async static get set public private protected readonly override".split()),
    "php": frozenset("abstract final readonly public private protected static".split()),
}
_NOT_METHODS = frozenset("if for while switch catch function constructor return with super new await yield typeof do else".split())
_CLASSES = {"javascript": frozenset(["class"]), "php": frozenset("class interface trait enum".split())}


class _Declarations:
    """Declarations of a file, found from its tokens: each token is looked at once, bodies of functions are passed over."""

    def __init__(self, filename: str, text: str, language: str):
        self.source, self.language = lexer.read(text, language), language
        self.words, self.places, self.partner = lexer.tokens(self.source.code)
        self.lines, self.text = _Lines(text), text
        self.comment_ends = [end for _, end in self.source.comments]
        # From each token on, the next brace or semicolon that stands in no parentheses opened since.
        self.stops = [len(self.words)] * (len(self.words) + 2)
        for i in range(len(self.words) - 1, -1, -1):
            self.stops[i] = i if self.words[i] in "{;}" else self.stops[self.partner.get(i, i) + 1 if self.words[i] in "([" else i + 1]
        space = re.search(r"^[ \t]*namespace[ \t]+([\w\\]+)", self.source.code, re.M) if language == "php" else None
        self.shared = {"language": language, "namespace": space[1] if space else ""}
        self.file = _entity(type="file", name=filename.rsplit("/", 1)[-1], signature=filename, body=text, line_start=1, line_end=len(self.lines.breaks) + 1, **self.shared)

    def docblock(self, start: int) -> str:
        i = bisect.bisect_right(self.comment_ends, start) - 1
        if i < 0:
            return ""
        first, end = self.source.comments[i]
        return self.text[first:end] if self.text.startswith("/**", first) and not self.text[end:start].strip() else ""

    def word(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def is_name(self, i: int) -> bool:
        return self.word(i)[:1].isalpha() or self.word(i)[:1] in ("_", "$", "#") and len(self.word(i)) > 0

    def begin(self, i: int) -> int:
        """The first of the modifiers before token i."""
        while self.word(i - 1) in _MODIFIERS[self.language]:
            i -= 1
        return i

    def found(self, kind: str, name: str, first: int, stop: int, owner: str) -> tuple[dict, int]:
        """The entity from token `first` to the block that opens at token `stop` (or ends there), and the token behind it."""
        start, opening = self.places[first], self.places[stop]
        if self.words[stop] == "{":
            last = self.partner.get(stop)
            end, after = (len(self.text), len(self.words)) if last is None else (self.places[last] + 1, last + 1)
        else:
            end, after = opening + 1, stop + 1
        signature = self.text[start:opening].split()
        hidden = next((x for x in ("private", "protected") if x in signature), "private" if name.startswith("#") else "public")
        entity = _entity(type=kind, name=name, class_name=owner, signature=" ".join(signature), docblock=self.docblock(start), body=self.text[start:end], line_start=self.lines.of(start), line_end=self.lines.of(end - 1), visibility=hidden, **self.shared)
        return entity, after

    def scan(self, i: int, end: int, owner: str) -> Iterator[dict]:
        while i < end:
            here = self.words[i]
            if here in _CLASSES[self.language] and self.is_name(i + 1) and self.word(i - 1) not in (".", "::", "->", "new") and not owner:
                stop = self.stops[i + 2]
                if self.word(stop) == "{" and self.word(i + 1) not in ("extends", "implements"):
                    entity, after = self.found(here, self.words[i + 1], self.begin(i), stop, "")
                    yield entity
                    yield from self.scan(stop + 1, min(after - 1, end), self.words[i + 1])
                    i = after
                    continue
            elif owner and self.language == "javascript":
                i, entity = self.member(i, end, owner)
                if entity:
                    yield entity
                continue
            elif here == "function" and self.word(i - 1) not in (".", "::", "->"):
                name = i + 1 + (self.word(i + 1) in ("*", "&"))
                if self.is_name(name) and self.word(name + 1) == "(":
                    stop = self.stops[name + 1]
                    if self.word(stop) == "{" or self.word(stop) == ";" and self.language == "php":
                        entity, i = self.found("method" if owner else "function", self.words[name], self.begin(i), stop, owner)
                        yield entity
                        continue
            elif here in ("const", "let", "var") and self.language == "javascript" and self.is_name(i + 1) and self.word(i + 2) == "=":
                at = i + 3 + (self.word(i + 3) == "async")
                arrow = self.partner.get(at, at) + 1
                if (self.word(at) == "(" or self.is_name(at)) and self.word(arrow) == "=>" and self.word(arrow + 1) == "{":
                    entity, i = self.found("arrow-function", self.words[i + 1], self.begin(i), arrow + 1, "")
                    yield entity
                    continue
            i += 1

    def member(self, i: int, end: int, owner: str) -> tuple[int, dict | None]:
        """A method of a class body at token i, and the next token to look at; other blocks are passed over."""
        here = self.words[i]
        if here in "([{":
            return self.partner.get(i, i) + 1, None
        if not self.is_name(i) or self.word(i + 1) != "(" or i + 1 not in self.partner or self.word(i - 1) in (".", "new", "=", "=>"):
            return i + 1, None
        stop = self.partner[i + 1] + 1
        if self.word(stop) == ":":
            stop = self.partner.get(stop + 1, stop) + 1 if self.word(stop + 1) == "{" else stop
            stop = self.stops[stop]
        if self.word(stop) != "{" or stop >= end:
            return stop, None
        if here in _NOT_METHODS:
            return self.partner.get(stop, end) + 1, None
        entity, after = self.found("method", here, self.begin(i), stop, owner)
        return after, entity


def brace_entities(filename: str, text: str, language: str) -> Iterator[dict]:
    """The file, its class-like declarations with their methods, and its functions."""
    found = _Declarations(filename, text, language)
    yield found.file
    yield from found.scan(0, len(found.words), "")


def script_entities(filename: str, text: str) -> Iterator[dict]:
    """The file as one entity, in the language of its `#!` line."""
    first = text.split("\n", 1)[0]
    found = next((name for pattern, name in INTERPRETERS if re.search(pattern, first)), "script") if first.startswith("#!") else "text"
    yield _entity(type="file", name=filename.rsplit("/", 1)[-1], signature=first, body=text, line_start=1, line_end=text.count("\n") + 1, language=found)


HELPERS: dict[str, Callable[[str, str], Iterator[dict]]] = {
    "python": python_entities,
    "javascript": lambda f, t: brace_entities(f, t, "javascript"),
    "php": lambda f, t: brace_entities(f, t, "php"),
    "css": css_entities,
    "script": script_entities,
    "plain": script_entities,
}


def extract_all(files: DataFrame, table: DataFrame, helpers: dict[str, Callable[[str, str], Iterator[dict]]] | None = None, strict: bool = False) -> DataFrame:
    """Entities of files of all kinds. `table` (ext, extractor, priority) names the extractor of each file; any function
    of (filename, content) that yields entities may be one. Files without an extractor give nothing; an extractor
    without a function gives the file entity. One pass: each row is read by its own extractor."""
    helpers = HELPERS | (helpers or {})
    routed = files.join(route_extractor(files.select("filename"), table), "filename")
    by_name = {None: script_entities} | helpers
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text, kind in zip(batch["filename"], batch["content"], batch["extractor"], strict=True):
                try:
                    rows += [{"extractor": kind, "filename": name} | e for e in by_name.get(kind, script_entities)(name, text or "")]
                except Exception as e:
                    if strict:
                        raise
                    rows.append({"extractor": kind, "filename": name, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["extractor", *columns]).astype(object).where(lambda d: d.notna(), None)

    return routed.select("filename", "content", "extractor").mapInPandas(run, "extractor string, " + SCHEMA)


def extract(files: DataFrame, language: str, strict: bool = False, helper: Callable[[str, str], Iterator[dict]] | None = None) -> DataFrame:
    """Entities of the files (filename, content). A failing file gives one row with `error`, or fails if `strict`."""
    helper = helper or HELPERS[language]
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["filename"], batch["content"], strict=True):
                try:
                    rows += [{"filename": name} | e for e in helper(name, text or "")]
                except Exception as e:
                    if strict:
                        raise
                    rows.append({"filename": name, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=columns).astype(object).where(lambda d: d.notna(), None)

    # A table of short texts is one small file, and would be one task; dealt out by name, all cores take part.
    session = files.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    return files.select("filename", "content").repartition(tasks, "filename").mapInPandas(run, SCHEMA)
