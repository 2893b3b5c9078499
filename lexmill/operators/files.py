"""File listings: languages, skipped directories, ignore rules, extractor routes, projects and prefixes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ancestors, basename, dirname, extension

#: Languages and their extensions, directories that are never entered, extractors by extension.
LANGUAGES = {
    "php": ("php",), "css": ("css", "scss", "sass", "less"), "js": ("js", "jsx", "ts", "tsx", "mjs"), "md": ("md", "markdown"), "html": ("html", "htm"),
    "python": ("py",), "ruby": ("rb",), "go": ("go",), "rust": ("rs",),
}
SKIP_DIRS = ("node_modules", "vendor", "__pycache__", "dist", "build", "coverage")
EXTRACTORS = (
    ("php", 80, ("php", "phtml")), ("css", 80, ("css", "scss", "sass", "less")), ("markdown", 80, ("md", "markdown", "mkd", "mdwn")),
    ("python", 100, ("py",)), ("script", 90, ("",)), ("javascript", 80, ("js", "jsx", "ts", "tsx", "mjs", "cjs")), ("plain", 10, ("py", "php", "js", "md", "")),
)
MARKERS = (".git", "composer.lock", "composer.json", "package-lock.json", "package.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "Pipfile", "pyproject.toml", "Cargo.toml", "Cargo.lock", "go.mod", "Gemfile", "mix.exs")


def language_of(path: Column, text: Column) -> Column:
    """Language by extension; files without one are scripts if they begin with `#!`; null for others."""
    known = F.create_map(*[F.lit(x) for name, exts in LANGUAGES.items() for e in exts for x in (e, name)])
    ext = extension(path)
    return F.when(ext == "", F.when(text.startswith("#!"), "script")).otherwise(F.try_element_at(known, ext))


def with_language(files: DataFrame) -> DataFrame:
    out = files.withColumn("language", language_of(F.col("filename"), F.col("content")))
    return out.where("language IS NOT NULL")


def drop_skipped_dirs(files: DataFrame) -> DataFrame:
    """Without files below a dot-directory or a directory of SKIP_DIRS; dot-files stay."""
    names = "|".join(map(re.escape, SKIP_DIRS))
    return files.where(~dirname(F.col("filename")).rlike(rf"(^|/)(\.[^/]+|{names})(/|$)"))


def glob_regex(pattern: str, exact: bool = False) -> str:
    """A regular expression for an ignore pattern below its directory; `exact` has real ranges in classes."""
    pattern = pattern.rstrip()
    only_dir, body = pattern.endswith("/"), pattern.rstrip("/")
    rooted, body = body.startswith("/"), body.lstrip("/")
    out = "" if rooted or "/" in body else "(?:.*/)?"
    for m in re.finditer(r"\*\*(/?)|\*|\?|\[([!^]?)([^\]]*)\]|(.)", body, re.S):
        piece = m[0]
        if piece.startswith("**"):
            out += ".*" + m[1]
        elif piece == "*":
            out += "[^/]*"
        elif piece == "?":
            out += "[^/]"
        elif m[4] is None:
            inner = m[3] if exact else re.escape(m[3])
            out += "[" + ("^" if m[2] else "") + inner + "]"
        else:
            out += re.escape(piece)
    return out + ("/" if only_dir else "")


def compile_ignore_rules(rules: DataFrame, mode: str = "reference") -> DataFrame:
    """dir, rule_no, pattern -> dir, rule_no, pattern, negated, regex (of whole paths), reaches_deep. The table is small."""

    @F.pandas_udf("string")
    def to_regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda x: glob_regex(x, exact=mode == "git"))

    rules = rules.withColumn("pattern", F.trim("pattern")).where("pattern <> '' AND NOT startswith(pattern, '#')")
    rules = rules.withColumn("negated", F.col("pattern").startswith("!"))
    bare = F.regexp_replace("pattern", "^!", "")
    end = "(/.*)?$" if mode == "git" else ""
    quoted = F.regexp_replace(F.col("dir"), r"([.+*?\[\](){}^$|\\])", r"\\$1")
    deep = ~bare.startswith("/") | (F.locate("/", bare, 2) > 0)
    return rules.select("dir", "rule_no", "pattern", "negated", F.concat(F.lit("^"), quoted, F.lit("/"), to_regex(bare), F.lit(end)).alias("regex"), deep.alias("reaches_deep"))


def _decide(paths: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """path -> allowed, by the last matching rule, or an include that reaches deep."""
    # Rule order: outer directories first, then the rule number.
    above = paths.select("path", F.explode(ancestors(F.regexp_replace("path", "/$", ""))).alias("dir"))
    hits = above.join(rules, "dir").where(F.expr("path RLIKE regex"))
    order = F.struct(F.length("dir").alias("depth"), F.col("rule_no"))
    found = hits.groupBy("path").agg(F.max(F.when(~F.col("negated"), order)).alias("out"), F.max(F.when(F.col("negated"), order)).alias("back"), F.max(F.when(F.col("negated") & F.col("reaches_deep"), F.lit(True))).alias("deep"))
    allowed = F.col("out").isNull() | F.coalesce(F.col("back") > F.col("out"), F.lit(False))
    if mode == "reference":
        allowed = allowed | F.coalesce(F.col("deep"), F.lit(False))
    return paths.join(found, "path", "left").select("path", allowed.alias("allowed"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame, mode: str = "reference", with_parents: bool = True, skip_dirs: bool = False) -> DataFrame:
    """Files that no rule hides. With `with_parents` each directory above must be visible too. With `skip_dirs`
    dot-directories and those of SKIP_DIRS stay hidden, whatever a rule includes.

    Paths meet rules by an equi-join on the ancestor directories, so the work follows the paths, not paths x rules.
    """
    rules = compile_ignore_rules(rules, mode)
    files = drop_skipped_dirs(files) if skip_dirs else files
    ok = _decide(files.select(F.col("filename").alias("path")).distinct(), rules, mode).where("allowed").select(F.col("path").alias("filename"))
    out = files.join(ok, "filename", "left_semi")
    if with_parents:
        dirs = files.select(F.explode(ancestors(F.col("filename"))).alias("dir")).distinct()
        hidden = _decide(dirs.select(F.concat("dir", F.lit("/")).alias("path")), rules, mode).where("NOT allowed").select(F.regexp_replace("path", "/$", "").alias("dir"))
        below = files.select("filename", F.explode(ancestors(F.col("filename"))).alias("dir")).join(hidden, "dir", "left_semi").select("filename").distinct()
        out = out.join(below, "filename", "left_anti")
    return out


def supported_extensions(table: DataFrame) -> DataFrame:
    """The distinct extensions of all extractors."""
    return table.select("ext").distinct()


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(e, name, p) for name, p, exts in EXTRACTORS for e in exts], "ext string, extractor string, priority int")


def route_extractor(files: DataFrame, table: DataFrame) -> DataFrame:
    """filename, extractor of the highest priority for its extension; files without one are absent."""
    found = files.select("filename", extension(F.col("filename")).alias("ext")).join(F.broadcast(table), "ext")
    best = Window.partitionBy("filename").orderBy(F.desc("priority"), "extractor")
    return found.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("filename", "extractor")


def longest_prefix(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path -> the longest project root at or above it (null if there is none)."""
    each = paths.select("path", F.explode(ancestors(F.col("path"))).alias("project_root"))
    best = each.join(roots.select("project_root").distinct(), "project_root").groupBy("path").agg(F.max_by("project_root", F.length("project_root")).alias("project_root"))
    return paths.join(best, "path", "left")


def inside_project(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Paths below any project root."""
    each = paths.select("path", F.explode(ancestors(F.col("path"))).alias("project_root"))
    return paths.join(each.join(roots, "project_root", "left_semi").select("path").distinct(), "path", "left_semi")


def project_candidates(listing: DataFrame) -> DataFrame:
    """Directories with marker files: directory, markers in priority order, the first of them."""
    order = F.array_position(F.array(*[F.lit(m) for m in MARKERS]), basename(F.col("filename")))
    found = listing.where(basename(F.col("filename")).isin(*MARKERS)).select(dirname(F.col("filename")).alias("directory"), F.struct(order.alias("at"), basename(F.col("filename")).alias("marker")).alias("m")).distinct()
    grouped = found.groupBy("directory").agg(F.array_sort(F.collect_list("m")).alias("m"))
    names = F.transform("m", lambda x: x["marker"])
    return grouped.select("directory", F.array_join(names, ",").alias("markers"), F.element_at(names, 1).alias("first_marker"))


def project_summary(files: DataFrame, entries: str = "entry_count") -> DataFrame:
    return files.groupBy("project_root").agg(F.count("*").alias("n_files"), F.coalesce(F.sum(entries), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.round(F.sum(entries) / F.count("*"), 1), F.lit(0.0)).alias("per_file"))


def by_language(files: DataFrame, entries: str = "entry_count") -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("n_files"), F.sum(entries).cast("long").alias("n_entities"))


def by_type(entities: DataFrame) -> DataFrame:
    """Entities by type with their share of all, over the few rows of types."""
    counts = entities.groupBy("type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def largest_files(files: DataFrame, k: int = 5, entries: str = "entry_count") -> DataFrame:
    return files.select("filename", entries).orderBy(F.desc(entries), "filename").limit(k)
