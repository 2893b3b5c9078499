"""Regular expressions over signature lines without a full scan: a stored table of trigrams names the candidates.

A pattern's mandatory literals are read from it; each has trigrams that a line must hold. A trigram's lines are listed by block of lines. Trigrams are of lower-cased lines, so
one table serves searches of both cases. Candidates are verified with the pattern itself; a pattern without a literal of three
letters scans the lines.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.symbols import find_symbols, shared_folder

#: Trigrams that a search asks for at most; the least frequent are not known, so the first ones of each literal are taken.
MAX_GRAMS = 64
#: Lines of a block; bytes of lines that are listed at once (the trigrams of a block may then have several rows).
BLOCK = 1 << 16
PASS_BYTES = 64 << 20

#: One alternative: literals that must all be there. A clause is a list of alternatives; all clauses must hold.
Clause = list[list[str]]


def clauses(pattern: str) -> list[Clause]:
    """What every match of the pattern holds; nothing if it cannot be read."""
    from re import _parser as parser  # the interpreter's own reading of patterns

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    return _of(tree)


def _of(items) -> list[Clause]:
    out: list[Clause] = []
    run = ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        repeated = name in ("MAX_REPEAT", "POSSESSIVE_REPEAT", "MIN_REPEAT")
        if len(run) >= 3:
            out.append([[run]])
        run = ""
        if name == "SUBPATTERN":
            out += _of(value[3])
        elif name == "ATOMIC_GROUP":
            out += _of(value)
        elif repeated and value[0] >= 1:
            out += _of(value[2])
        elif name == "BRANCH":
            parts = [_of(x) for x in value[1]]
            if all(parts):
                # Of each branch its clauses with one alternative count together.
                ways = [[lit for clause in p if len(clause) == 1 for lit in clause[0]] for p in parts]
                if all(ways):
                    out.append(ways)
    return out


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(0)), F.lit(1)), lambda i: F.substring(low, i, F.lit(3))))


def block_grams(stored: DataFrame) -> DataFrame:
    """gram, block, n, held: of each block of BLOCK lines (line_id / BLOCK) the lines that have a trigram, as places in the block.

    Lines of a block stand together in their file, so a block's trigrams are listed where it is read, a few rows a block: no row for each trigram
    of each line is dealt out. A block that two batches share has rows of both.
    """

    def listed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        lists, ids = pa.concat_arrays(table.column("grams").chunks), table.column("line_id").to_numpy()
        grams = lists.flatten().dictionary_encode()
        ids = np.repeat(ids, lists.value_lengths().to_numpy())
        code, block = grams.indices.to_numpy(), ids // BLOCK
        order = np.lexsort((ids, block, code))
        code, block, place = code[order], block[order], (ids % BLOCK)[order].astype(np.int32)
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        held = pa.ListArray.from_arrays(pa.array(np.append(at, len(code)), pa.int32()), pa.array(place))
        return pa.RecordBatch.from_pydict({"gram": grams.dictionary.take(pa.array(code[at])), "block": block[at], "held": held})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[pa.RecordBatch] = []
        for batch in batches:
            taken.append(batch)
            if sum(b.num_rows for b in taken) >= BLOCK or sum(b.nbytes for b in taken) >= PASS_BYTES:
                yield listed(taken)
                taken = []
        if taken:
            yield listed(taken)

    each = stored.select("line_id", _grams(F.col("line")).alias("grams"))
    return each.mapInArrow(run, "gram string, block long, held array<int>")


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines (kind, line; other columns stay) with an id, and their trigrams by block, dealt out and sorted by trigram."""
    spark = lines.sparkSession
    # Written first: ids must not change between the two tables.
    lines.withColumn("line_id", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/lines")
    stored = spark.read.parquet(f"{path}/lines").where("length(line) >= 3")
    # Dealt out by a hash of trigram and block, so a trigram that most lines have is no hot task.
    block_grams(stored).repartition("gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """line_id of the lines that hold what the pattern needs; None if it needs nothing."""
    asked = [[[_of_text(lit) for lit in way] for way in clause] for clause in clauses(pattern)]
    if not asked:
        return None
    wanted = sorted({g for clause in asked for way in clause for lit in way for g in lit})
    rows = spark.read.parquet(f"{path}/grams").where(F.col("gram").isin(wanted))
    lists = [F.flatten(F.collect_list(F.when(F.col("gram") == g, F.col("held")))).alias(f"g{i}") for i, g in enumerate(wanted)]
    blocks = rows.groupBy("block").agg(*lists)  # BLOCK places a trigram at most
    name = lambda gram: f"g{wanted.index(gram)}"
    common = lambda names: reduce(F.array_intersect, [F.col(n) for n in names])
    clause = lambda ways: F.array_distinct(F.flatten(F.array(*[common([name(g) for g in sorted({g for lit in way for g in lit})]) for way in ways])))
    ok = reduce(F.array_intersect, [clause(ways) for ways in asked])
    return blocks.select("block", F.explode(ok).alias("place")).select((F.col("block") * BLOCK + F.col("place")).alias("line_id"))


def _of_text(literal: str) -> list[str]:
    low = literal.lower()
    return list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))[:MAX_GRAMS]


def find_lines(spark: SparkSession, path: str, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Lines of the stored table that match; only candidates meet the pattern."""
    lines = spark.read.parquet(f"{path}/lines")
    some = candidates(spark, path, pattern)
    return find_symbols(lines if some is None else lines.join(some, "line_id", "left_semi"), pattern, ignore_case).drop("line_id")


def line_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/lines-{uuid.uuid4()}"
