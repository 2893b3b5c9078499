"""Language identification with language-bitmask n-gram filters.

Training learns which byte n-grams of the folded text are usual in each language (document share of at least
MIN_SHARE) and sets that language's bit in the Bloom slots of the n-gram. The filter is bit-sliced: one slot
holds a bit for every language, so the AND of an n-gram's slots names all languages that contain it. A text is
scored by the popcount of each language over its n-grams, corrected for that language's false-positive rate.

The filter is fitted on about MAX_TRAIN_ROWS labelled rows at most. The bound is dealt out by language: those with
fewer rows than an equal share give all, the others fill the rest, chosen by a hash of doc_id; each gives one row at
least, so every language with rows to train on is learned at every size. A rule fixes the filter's size (SLOTS slots
a plane of 64 languages), so it may be sent to every task. Prediction reads the text alone.

Defined cases: a null text or one without letters is `und` with score 0; a text none of whose n-grams is known
gets the commonest training language with score 0; ties go to the smaller language name; a null doc_id is never
held out and never trained on; with no labelled rows every text is `und`; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm import words as w
from lexmill.llm.tables import per_batch

GRAM_BYTES = 4
SLOTS = 1 << 20
HASHES = 2
MAX_TRAIN_ROWS = 20_000
MIN_SHARE = 0.01
UNKNOWN = "und"

#: ASCII bytes that are no letters become a space.
FOLD = w.IDENTITY.copy()
FOLD[:128] = [c if 97 <= c < 123 else 32 for c in range(128)]
_LETTER = re.compile("[A-Za-z]")


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the n-grams inside each text (none with two spaces in a row) and their texts."""
    data, offsets = w.text_bytes(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    data = FOLD[data]
    n = len(data) - GRAM_BYTES + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(texts)
    code = np.zeros(n, np.uint32)
    for k in range(GRAM_BYTES):
        code |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    space = data == 32
    double = space[:-1] & space[1:]
    bad = np.zeros(n, bool)
    for k in range(GRAM_BYTES - 1):
        bad |= double[k : k + n]
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keep = ~bad & (doc[:n] == doc[GRAM_BYTES - 1 :])
    return code[keep].astype(np.uint64), doc[:n][keep], len(texts)


def _slots(code: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        value = w.mix(code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return [((value >> np.uint64(24 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class LanguageFilter:
    """planes[p][slot] has the bits of languages 64p to 64p+63."""

    def __init__(self, languages: list[str], planes: np.ndarray, commonest: str):
        self.languages, self.planes, self.commonest = languages, planes, commonest
        bits = [(planes[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false_rate = np.array([float(b.mean()) ** HASHES for b in bits])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        code, doc, n = _grams(texts)
        slots = _slots(code)
        total = np.bincount(doc, minlength=n).astype(float)
        counts = np.zeros((len(self.languages), n))
        for p, plane in enumerate(self.planes):
            mask = plane[slots[0]]
            for s in slots[1:]:
                mask = mask & plane[s]
            for i in range(64 * p, min(64 * p + 64, len(self.languages))):
                counts[i] = np.bincount(doc, ((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(float), minlength=n)
        rate = self.false_rate[:, None] if len(self.languages) else np.zeros((0, 1))
        counts = np.maximum(0.0, (counts - rate * total) / np.maximum(1 - rate, 1e-9))
        out, score = [], np.zeros(n)
        for d, text in enumerate(texts.to_pylist()):
            if not text or not self.languages or not (_LETTER.search(text) or any(map(str.isalpha, text))):
                out.append(UNKNOWN)
            elif (most := counts[:, d].max()) <= 0:
                out.append(self.commonest)
            else:
                out.append(self.languages[int(np.argmax(counts[:, d]))])
                score[d] = most / counts[:, d].sum()
        return out, score


def shares(counts: dict[str, int], max_rows: int) -> dict[str, float]:
    """Of each language the share of rows to train on: all of those below an equal part of what the smaller ones leave."""
    out, left = {}, max_rows
    for i, x in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        part = min(float(counts[x]), left / (len(counts) - i))
        out[x] = part / counts[x]
        left -= part
    return out


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS, min_share: float = MIN_SHARE) -> LanguageFilter:
    """Fit on rows with a non-null lang that are not held out; about `max_rows` of them at most, dealt out by language."""
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    place_of = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40))
    found = {r["lang"]: r for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.min(place_of).alias("low")).collect()}
    counts = {x: r["n"] for x, r in found.items()}
    if sum(counts.values()) > max_rows:
        limits = [(x, max(int(share * (1 << 40)), found[x]["low"] + 1)) for x, share in shares(counts, max_rows).items()]
        usable = usable.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long")), "lang").where(place_of < F.col("below")).select("doc_id", "text", "lang")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        langs, number = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
        for a, b in w.chunks(batch.column("text")):
            code, doc, _ = _grams(batch.column("text").slice(a, b - a))
            pairs = np.unique((doc.astype(np.uint64) << np.uint64(32)) | code)
            of, gram = number[a + (pairs >> np.uint64(32)).astype(np.int64)], pairs & np.uint64(0xFFFFFFFF)
            keys, df = np.unique((of.astype(np.uint64) << np.uint64(32)) | gram, return_counts=True)
            yield {"lang": pa.array(langs[(keys >> np.uint64(32)).astype(np.int64)].tolist(), pa.string()), "gram": (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), "df": df}

    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    planes = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
    if not languages:
        return LanguageFilter([], planes, UNKNOWN)
    known = docs.sparkSession.createDataFrame([(x, i, float(max(min(2, sizes[x]), min_share * sizes[x]))) for i, x in enumerate(languages)], "lang string, number int, least double")
    grams = per_batch(usable, make, "lang string, gram long, df long").groupBy("lang", "gram").agg(F.sum("df").alias("df")).join(F.broadcast(known), "lang").where("df >= least").select("gram", "number")

    def place(batch: pa.RecordBatch) -> Iterator[dict]:
        number = batch.column("number").to_numpy()
        for slot in _slots(batch.column("gram").to_numpy().astype(np.uint64)):
            yield {"slot": slot, "plane": (number // 64).astype(np.int32), "bits": np.uint64(1) << (number % 64).astype(np.uint64)} | {"bits": (np.uint64(1) << (number % 64).astype(np.uint64)).view(np.int64)}

    for r in per_batch(grams, place, "slot long, plane int, bits long").groupBy("slot", "plane").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # at most SLOTS rows a plane
        planes[r["plane"], r["slot"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return LanguageFilter(languages, planes, min(languages, key=lambda x: (-counts[x], x)))


def identify(docs: DataFrame, model: LanguageFilter | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. Without a model, one is fitted on the rows that are not held out."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b in w.chunks(batch.column("text")):
            langs, score = shared.value.predict(batch.column("text").slice(a, b - a))
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "held_out": batch.column("held_out").slice(a, b - a), "lang_pred": pa.array(langs, pa.string()), "score": score}

    return per_batch(docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), F.col("text").cast("string")), scan, "doc_id long, held_out boolean, lang_pred string, score double")
