"""A data source that lists source trees: directories that are hidden are never entered.

Partitions are directories: the driver lists the uppermost levels until there are enough of them, tasks list what is below.
Directories that skip or ignore rules hide are cut while listing, with the same rules as files.apply_ignore_rules() applies
to tables of paths; ignore files that lie in the tree join the rules for what is below them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexmill.operators.files import SKIP_DIRS, glob_regex

SCHEMA = "filename string, mtime long, length long, content binary"
#: Directories that the driver makes partitions of, about.
PARTITIONS = 256


@dataclass(frozen=True)
class Rule:
    """One ignore rule of a directory; later rules of the same or a lower directory come first."""

    order: tuple[int, int]
    negated: bool
    deep: bool
    pattern: re.Pattern


def rules_of(directory: str, lines: list[tuple[int, str]], mode: str) -> list[Rule]:
    """The rules that the lines (number, pattern) of a directory's ignore file make."""
    out = []
    for number, line in lines:
        line = line.strip(" ")
        if not line or line.startswith("#"):
            continue
        bare = line.removeprefix("!")
        regex = "^" + re.escape(directory) + "/" + glob_regex(bare, exact=mode == "git") + ("(/.*)?$" if mode == "git" else "")
        out.append(Rule((len(directory), number), line.startswith("!"), not bare.startswith("/") or "/" in bare[1:], re.compile(regex, re.S)))
    return out


def visible(path: str, rules: tuple[Rule, ...], mode: str) -> bool:
    """Whether the last rule that matches lets the path be, or an include that reaches deep does."""
    hits = [r for r in rules if r.pattern.match(path)]
    out = max((r.order for r in hits if not r.negated), default=None)
    back = max((r.order for r in hits if r.negated), default=None)
    return out is None or back is not None and back > out or mode == "reference" and any(r.negated and r.deep for r in hits)


@dataclass
class Directories(InputPartition):
    """What one task lists: a directory with all below it, or (`deep` false) only the files in it."""

    path: str
    rules: tuple[Rule, ...]
    deep: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.mode = options["path"], options.get("mode", "reference")
        self.skip = options.get("skip", "true") == "true"
        self.ignore_name = options.get("ignorename")
        self.content = options.get("content", "false") == "true"
        self.given = [tuple(r) for r in json.loads(options.get("rules", "[]"))]
        self.partitions_wanted = int(options.get("partitions", PARTITIONS))

    def fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def listed(self, fs: pafs.FileSystem, path: str, rules: tuple[Rule, ...]) -> tuple[list, list, tuple[Rule, ...]]:
        """Visible directories and files of a directory, and the rules that hold in it."""
        try:
            entries = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        except PermissionError:
            return [], [], rules
        entries = [(e.path.replace("\\", "/"), e) for e in entries]
        rules = (*rules, *rules_of(path, [(n, p) for d, n, p in self.given if d == path], self.mode))
        own = next((p for p, e in entries if self.ignore_name and e.base_name == self.ignore_name and e.is_file), None)
        if own:
            with fs.open_input_stream(own) as f:
                lines = f.read().decode("utf-8", "replace").splitlines()
            rules = (*rules, *rules_of(path, list(enumerate(lines, 1)), self.mode))
        hidden = lambda e: self.skip and (e.base_name.startswith(".") or e.base_name in SKIP_DIRS)
        dirs = [p for p, e in entries if e.type == pafs.FileType.Directory and not hidden(e) and visible(f"{p}/", rules, self.mode)]
        files = [(p, e) for p, e in entries if e.is_file and visible(p, rules, self.mode)]
        return sorted(dirs), sorted(files, key=lambda x: x[0]), rules

    def partitions(self) -> list[InputPartition]:
        fs, root = self.fs()
        done, waiting = [], [Directories(root.rstrip("/"), (), True)]
        while waiting and len(done) + len(waiting) < self.partitions_wanted:
            level: list[Directories] = []
            for d in waiting:
                below, _, rules = self.listed(fs, d.path, d.rules)
                done.append(Directories(d.path, d.rules, False))
                level += [Directories(p, rules, True) for p in below]
            waiting = level
        return done + waiting

    def read(self, partition: Directories) -> Iterator[tuple]:
        fs, _ = self.fs()
        waiting = [(partition.path, partition.rules)]
        while waiting:
            path, rules = waiting.pop()
            dirs, files, rules = self.listed(fs, path, rules)
            for name, info in files:
                content = None
                if self.content:
                    with fs.open_input_stream(name) as f:
                        content = f.read()
                yield name, info.mtime_ns // 1_000_000_000 if info.mtime_ns else None, info.size, content
            if partition.deep:
                waiting += [(d, rules) for d in dirs]


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, rules: list[tuple[str, int, str]] | None = None, ignore_name: str | None = None, mode: str = "reference", skip: bool = True, content: bool = False, partitions: int = PARTITIONS) -> DataFrame:
    """filename, mtime, length (and content) of the visible files below `root`, a path or address of any file system that
    Arrow knows. rules: (directory, number, pattern), besides those of the tree's own files of the name `ignore_name`."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("rules", json.dumps(rules or [])).option("mode", mode).option("skip", str(skip).lower()).option("content", str(content).lower()).option("partitions", partitions)
    files = (reader if ignore_name is None else reader.option("ignorename", ignore_name)).load(root)
    return files if content else files.drop("content")
