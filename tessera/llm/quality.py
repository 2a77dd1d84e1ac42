"""Quality rules kept as a ledger: every rule is evaluated once, its outcome is one bit.

The ledger holds a document's measurements and ``failure_bits``. A policy is a mask of rules
under a version name; applying one is a bitwise AND, and what each rule costs is read from the
counts of the distinct bit patterns, so no text is read again for a new policy or an ablation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import map_texts, table_of, text_bytes, text_slices

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "unspaced_chars", "giant_chars")
GIANT = 1000  # code points; longer words are no words of a language
# fixed values: scripts written without blanks (Thai, Lao, Tibetan, Myanmar, Khmer, CJK with kana, full-width forms)
UNSPACED = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x9FFF), (0xF900, 0xFAFF),
            (0xFF00, 0xFFEF), (0x20000, 0x3FFFF)]

# name, condition under which the document fails; a rule's place is its bit
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars - unspaced_chars - giant_chars > 30 * n_words"),
    ("giant_words", "5 * giant_chars > 4 * word_chars"),
    ("mostly_symbols", "2 * n_symbols > word_chars"),
    ("duplicate_lines", "n_lines >= 5 and 10 * n_dup_lines > 7 * n_lines"),
]
BASE = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": BASE + ("short_words", "long_words", "giant_words"),
    "v2": tuple(name for name, _ in RULES),
}
PRODUCTION = "v2"


def mask_of(rules: tuple[str, ...]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in set(rules))


def _repeat_words(codes: list[int], window: int) -> int:
    """Words that lie in a window found twice or more."""
    grams = list(zip(*[codes[k:] for k in range(window)]))
    seen = Counter(grams)
    edge = np.zeros(len(codes) + 1, dtype=np.int64)
    hit = np.fromiter((seen[g] > 1 for g in grams), dtype=bool, count=len(grams)).nonzero()[0]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge) > 0).sum())


_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")
_LEADS = bytes(range(0xE0, 0x100))


def _unspaced(text: bytes) -> int:
    """Code points of scripts written without blanks."""
    if len(text) == len(text.translate(None, _LEADS)):  # no character of three bytes or more
        return 0
    return len(_UNSPACED.findall(text.decode("utf-8", "replace")))


def _code_points(text: bytes) -> int:
    return len(text.translate(None, bytes(range(0x80, 0xC0))))


def measure(texts: list[bytes], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The measurements of each text. ``giant_chars`` are the code points of words longer than GIANT, those of
    ``unspaced_chars`` aside, so that neither a data address in a long text nor a sentence without blanks counts against it.

    Repeated windows are looked for over the whole slice at once by a 64-bit sum per window; only
    texts in which two windows share a sum are counted, and those by the words themselves.
    """
    n = len(texts)
    out = {m: np.zeros(n, dtype=np.int64) for m in MEASURES}
    codes: list[int] = []
    known: dict[bytes, int] = {}
    starts = np.zeros(n + 1, dtype=np.int64)
    dirty = SPACES + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a character
    for i, t in enumerate(texts):
        words = t.split()
        codes.extend([known.setdefault(w, len(known)) for w in words])
        starts[i + 1] = len(codes)
        out["word_chars"][i] = len(t.translate(None, dirty))
        out["n_symbols"][i] = len(t) - len(t.translate(None, SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip()] if b"\n" in t else ([t] if words else [])
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["unspaced_chars"][i] = _unspaced(t)
        giants = [w for w in words if len(w) > GIANT and _code_points(w) > GIANT]
        out["giant_chars"][i] = sum(_code_points(w) - _unspaced(w) for w in giants)
    out["n_words"] = np.diff(starts)
    total = len(codes)
    if total >= window:
        rng = np.random.default_rng(1)
        value = rng.integers(0, 1 << 64, size=len(known), dtype=np.uint64)[np.array(codes)]
        odd = rng.integers(0, 1 << 63, size=window, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sums = np.zeros(total - window + 1, dtype=np.uint64)
        for k in range(window):
            sums += value[k:total - window + 1 + k] * odd[k]
        doc = np.repeat(np.arange(n), out["n_words"])
        inside = doc[:total - window + 1] == doc[window - 1:]
        sums, doc = sums[inside], doc[:total - window + 1][inside]
        order = np.lexsort((sums, doc))
        sums, doc = sums[order], doc[order]
        twice = (sums[1:] == sums[:-1]) & (doc[1:] == doc[:-1])
        for i in np.unique(doc[1:][twice]).tolist():
            out["n_repeat_words"][i] = _repeat_words(codes[starts[i]:starts[i + 1]], window)
    return out


def _failure_bits() -> Column:
    bit = F.lit(0).cast("long")
    for i, (_, failed) in enumerate(RULES):
        bit = bit.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(0).cast("long"))
    return bit


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failure_bits): one row per document, repeated rows included.

    A null text has no words, lines or symbols, and so fails ``few_words``; a null doc_id stays null.
    Other columns of ``docs`` are ignored. One pass over the texts, no shuffle.
    """
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            m = measure(text_bytes(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(m[k]) for k in MEASURES]],
                                             ["doc_id", *MEASURES])
    schema = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
    measured = map_texts(docs.select(F.col("doc_id").cast("long"), "text"), fill, schema)
    return measured.withColumn("failure_bits", _failure_bits())


def kept_under(policy: str = PRODUCTION) -> Column:
    """Whether a ledger row passes every rule of the policy."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """(rule, failed, only_this): documents that fail a rule, and those the policy would keep without it.

    The ledger is first counted by bit pattern, at most two to the number of rules rows.
    """
    mask = mask_of(POLICIES[policy])
    patterns = book.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, (name, _) in enumerate(RULES) if mask >> i & 1])
    return (patterns.select("bits", "n", F.inline(rules)).groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this")))


def stored(docs: DataFrame, policy: str = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """(ledger, ablations) of ``docs``, both written to the shared folder; policies are applied to what is stored."""
    book = table_of(ledger(docs), "ledger")
    return book, table_of(ablations(book, policy), "ablations")


def verdicts(book: DataFrame) -> DataFrame:
    """The ledger with one column ``kept_<version>`` for every policy: each is a mask over the stored bits."""
    return book.withColumns({f"kept_{name}": kept_under(name) for name in POLICIES})


def keep_passing(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents that pass the policy, with all their columns.

    Rows are measured, given their failure bits and passed on in one scan; the policy's mask says which stay.
    """
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            m = measure(text_bytes(b))
            doc = pa.StructArray.from_arrays(b.columns, fields=list(b.schema))
            yield pa.RecordBatch.from_arrays([doc, *[pa.array(m[k]) for k in MEASURES]], ["doc", *MEASURES])
    schema = StructType([StructField("doc", docs.schema), *[StructField(k, LongType()) for k in MEASURES]])
    judged = map_texts(docs, fill, schema).withColumn("failure_bits", _failure_bits())
    return judged.where(kept_under(policy)).select("doc.*")
