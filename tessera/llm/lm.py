"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

A token's probability is P(class | the classes before it) * P(token | class). Words that make up a stated share of
all training tokens are classes of their own; the others share the class of their last two characters, where that makes
up such a share, or one for rare endings. So the classes follow the corpus, and are never more than the share allows.
The first factor is the neural model: the vectors of the preceding classes, each through the matrix
of its position, add up to a predicted vector, whose products with the classes' output vectors
plus their biases are the scores, normalised over all classes. It is trained in numpy on every
training document against noise drawn from the classes' frequencies. The second factor is counted
over the training documents with absolute discounting; what is discounted in a class is the
probability of its unseen words, so unknown words have a probability as well.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table_of, text_bytes, text_slices

HEAD_WORDS = 1 << 17
HEAD_BYTES = 64
CLASS_SHARE = 1 / 4096  # of all training tokens: words and endings with as much are classes of their own
SUFFIX = 2
ROUNDS = 3  # of training and averaging, each on its part of the documents
CONTEXT = 2
DIMENSIONS = 16
NOISE = 64
BATCH = 1024
RATE = 0.1
DISCOUNT = 0.5
FLUSH_WORDS = 300_000
AVERAGERS = 32


def held_out(doc_id: Column) -> Column:
    """One document in five, by the digest of its doc_id (a null doc_id is the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; the end of a text is the empty word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])
        seen: Counter = Counter()
        for b in text_slices(batches):
            for t in text_bytes(b):
                seen.update(t.lower().split())
            seen[b""] += b.num_rows
            if len(seen) > FLUSH_WORDS:
                yield flush(seen)
                seen = Counter()
        if seen:
            yield flush(seen)
    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The words known to every task, the classes, and the counts that probabilities are made of."""

    def __init__(self, head: list[tuple[str, int]], suffixes: list[tuple[str, int, int]], rest: tuple[int, int],
                 tokens: int, types: int):
        """head: (word, n), most frequent first; suffixes: (ending, tokens, types) of the shared classes."""
        self.tokens, self.types = tokens, types
        own = [(w, n) for w, n in head if w != "" and n >= CLASS_SHARE * tokens]
        ends = sum(n for w, n in head if w == "")
        self.suffix_class = {s: 1 + len(own) + i for i, (s, _, _) in enumerate(suffixes)}
        self.rest_class = 1 + len(own) + len(suffixes)
        self.classes = self.rest_class + 1
        totals = [ends] + [n for _, n in own] + [c for _, c, _ in suffixes] + [rest[0]]
        self.class_tokens = np.array(totals, dtype=np.float64)
        distinct = np.array([0] * (1 + len(own)) + [v for _, _, v in suffixes] + [rest[1]], dtype=np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.seen_offset = np.where(self.class_tokens > 0, -np.log10(self.class_tokens), 0.0)
            self.unseen = np.where(self.class_tokens > 0, np.log10(DISCOUNT * distinct / self.class_tokens), 0.0)
        self.unseen[~np.isfinite(self.unseen)] = 0.0
        self.word: dict[bytes, int] = {w.encode(): i for i, (w, _) in enumerate(head)}
        own_class = {w: i + 1 for i, (w, _) in enumerate(own)} | {"": 0}
        self.word_class = np.array([own_class[w] if w in own_class else self.shared_class(w) for w, _ in head], dtype=np.int32)
        n = np.array([c for _, c in head], dtype=np.float64)
        self.word_base = np.log10((n + 0.5) / self.denominator)
        alone = np.array([w in own_class for w, _ in head], dtype=bool)
        self.word_within = np.where(alone, 0.0, np.log10(np.maximum(n - DISCOUNT, DISCOUNT)) + self.seen_offset[self.word_class]
                                    if len(head) else 0.0)

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)

    def shared_class(self, word: str) -> int:
        return self.suffix_class.get(word[-SUFFIX:], self.rest_class)

    def encode(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of each text, their number, head word or -1 of each token, class of each); b"" is the end."""
        words = [t.lower().split() for t in texts]
        for ws in words:
            ws.append(b"")
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = list(chain.from_iterable(words))
        place = np.fromiter(map(self.word.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        classes = self.word_class[place] if len(self.word_class) else np.zeros(len(place), dtype=np.int32)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            rare = [flat[i] for i in unknown.tolist()]
            memo = {w: self.shared_class(w.decode()) if w else 0 for w in set(rare)}
            classes[unknown] = [memo[w] for w in rare]
        return words, sizes, place, classes


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS) -> Vocabulary:
    """The vocabulary of a table of counts; what comes to the driver is bounded by the parameters."""
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # the frequent words are those of the fullest octaves' sixteenths that hold at most head_words words:
    # a sort with a limit would bring that many rows of every partition to the driver
    grade = F.floor(F.log2("n") * 16).cast("int")
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("grade", grade)
    least, held = None, 0
    for r in sorted(short.groupBy("grade").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["grade"]):
        held += r["words"]
        if held > head_words:
            break
        least = r["grade"]
    head = [] if least is None else [(r[0], r[1]) for r in short.where(F.col("grade") >= least).select("word", "n").collect()]
    head.sort(key=lambda x: (-x[1], x[0]))
    if all(w != "" for w, _ in head):
        head += [(r[0], r[1]) for r in counts.where("word = ''").collect()]
    own = [w for w, n in head if w != "" and n >= CLASS_SHARE * tokens]
    shared = counts.where(~F.col("word").isin(["", *own]))
    ending = F.substring("word", -SUFFIX, SUFFIX)
    groups = shared.groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    suffixes = [tuple(r) for r in groups.where(F.col("n") >= CLASS_SHARE * tokens).orderBy(F.desc("n"), "ending").collect()]
    all_n, all_v = shared.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    rest = (all_n - sum(s[1] for s in suffixes), all_v - sum(s[2] for s in suffixes))
    return Vocabulary(head, suffixes, rest, tokens, types)


class LogBilinear:
    """The model of the classes: vectors in and out, a matrix per context position, biases."""

    def __init__(self, classes: int, frequencies: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.noise = (frequencies + 0.5) / (frequencies + 0.5).sum()
        self.into = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
        self.out = rng.normal(0, 0.1, (classes, DIMENSIONS)).astype(np.float32)
        self.mix = np.stack([np.eye(DIMENSIONS, dtype=np.float32)] * CONTEXT)
        self.bias = np.log(self.noise).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.into, self.out, self.mix, self.bias]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = vector[at:at + p.size].reshape(p.shape)
            at += p.size

    @staticmethod
    def contexts(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The classes before each token, nearest first; before a text's start stands the end class."""
        doc_start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(len(classes))
        return np.stack([np.where(at - k >= doc_start, classes[np.maximum(at - k, 0)], 0) for k in range(1, CONTEXT + 1)])

    def train(self, contexts: np.ndarray, targets: np.ndarray, rng: np.random.Generator, grown: list[np.ndarray]) -> None:
        """One pass of noise-contrastive estimation in batches, with Adagrad's sums in ``grown``.

        A batch shares its noise classes. The model's scores are taken as log-probabilities, so
        telling a token from noise is a logistic choice on score - log(NOISE * noise probability).
        """
        shift = np.log(NOISE * self.noise).astype(np.float32)
        edges = np.cumsum(self.noise)
        dims = np.arange(DIMENSIONS)

        def scatter(where: np.ndarray, rows: np.ndarray) -> np.ndarray:
            cells = (where[:, None] * DIMENSIONS + dims).ravel()
            return np.bincount(cells, rows.ravel(), minlength=self.into.size).reshape(self.into.shape).astype(np.float32)

        def step(p: np.ndarray, total: np.ndarray, gradient: np.ndarray) -> None:
            total += gradient * gradient
            p += RATE * gradient / np.sqrt(total + 1e-8)

        for a in range(0, len(targets), BATCH):
            t, c = targets[a:a + BATCH], contexts[:, a:a + BATCH]
            drawn = np.minimum(np.searchsorted(edges, rng.random(NOISE)), len(edges) - 1)
            before = [self.into[c[k]] for k in range(CONTEXT)]
            q = sum(before[k] @ self.mix[k] for k in range(CONTEXT))
            true, false = self.out[t], self.out[drawn]
            s_true = np.einsum("ij,ij->i", q, true) + self.bias[t] - shift[t]
            s_false = q @ false.T + self.bias[drawn] - shift[drawn]
            g_true = 1 / (1 + np.exp(np.clip(s_true, -30, 30)))
            g_false = -1 / (1 + np.exp(np.clip(-s_false, -30, 30)))
            scale = np.float32(1 / len(t))
            g_true, g_false = g_true * scale, g_false * scale
            d_q = g_true[:, None] * true + g_false @ false
            d_out = scatter(t, g_true[:, None] * q)
            np.add.at(d_out, drawn, g_false.T @ q)
            d_bias = np.bincount(t, g_true, minlength=len(self.bias)) + np.bincount(drawn, g_false.sum(axis=0), minlength=len(self.bias))
            d_into = sum(scatter(c[k], d_q @ self.mix[k].T) for k in range(CONTEXT))
            d_mix = np.stack([before[k].T @ d_q for k in range(CONTEXT)])
            for p, total, g in zip(self.parameters(), grown, (d_into, d_out, d_mix, d_bias.astype(np.float32))):
                step(p, total, g)

    def log10_probabilities(self, contexts: np.ndarray, targets: np.ndarray, cells: int = 1 << 21) -> np.ndarray:
        """Normalised log-probabilities of classes; each different context is normalised once."""
        k = len(self.bias)
        step = max(1, cells // k)
        key = contexts[0].astype(np.int64)
        for c in contexts[1:]:
            key = key * k + c
        keys, inverse = np.unique(key, return_inverse=True)
        tables = [self.into @ m for m in self.mix]
        q = np.zeros((len(keys), DIMENSIONS), dtype=np.float32)
        left = keys.copy()
        for i in range(CONTEXT - 1, -1, -1):
            q += tables[i][left % k]
            left //= k
        norm = np.empty(len(keys), dtype=np.float64)
        for a in range(0, len(keys), step):
            s = q[a:a + step] @ self.out.T
            s += self.bias
            top = s.max(axis=1, keepdims=True)
            s -= top
            np.exp(s, out=s)
            norm[a:a + step] = np.log(s.sum(axis=1)) + top[:, 0]
        own = np.einsum("ij,ij->i", q[inverse], self.out[targets]) + self.bias[targets]
        return (own - norm[inverse]) / math.log(10)


def trained(docs: DataFrame, words: Vocabulary, seed: int = 11, rounds: int = ROUNDS) -> LogBilinear:
    """The model after one pass over ``docs``, in ``rounds`` parts.

    In each round every task trains on its texts of that part from the model of the round before, with the step sizes reached
    there; models and step sizes are averaged, each weighing as many tokens as it saw, first in a fixed number of
    tasks and then those few on the driver. The number of rounds doesn't follow the number of tasks. A model is as large as its
    classes, whatever the corpus.
    """
    spark = docs.sparkSession
    model = LogBilinear(words.classes, words.class_tokens, seed)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(words))
    start, size = np.concatenate((model.vector(), np.zeros_like(model.vector()))), len(model.vector())
    schema = pa.schema([("tokens", pa.int64()), ("parameters", pa.binary())])
    part = F.pmod(F.xxhash64("text"), F.lit(rounds))

    def fitting(turn: int, begin):
        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pickle.loads(shared.value)
            own = LogBilinear(known.classes, known.class_tokens, seed)
            own.load(begin.value[:size])
            rng = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            held, seen = LogBilinear(known.classes, known.class_tokens, seed), 0
            held.load(begin.value[size:])
            for b in text_slices(batches):
                _, sizes, _, classes = known.encode(text_bytes(b))
                own.train(own.contexts(classes, sizes), classes, rng, held.parameters())
                seen += len(classes)
            if seen:
                yield pa.RecordBatch.from_pylist([{"tokens": seen, "parameters": np.concatenate((own.vector(), held.vector())).tobytes()}],
                                                 schema)
        return fit

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean = 0, None
        for b in batches:
            for row in b.to_pylist():
                v = np.frombuffer(row["parameters"], dtype=np.float32).astype(np.float64)
                total += row["tokens"]
                mean = v if mean is None else mean + (v - mean) * (row["tokens"] / total)
        if mean is not None:
            yield pa.RecordBatch.from_pylist([{"tokens": total, "parameters": mean.astype(np.float32).tobytes()}], schema)
    for turn in range(rounds):
        fit = fitting(turn, spark.sparkContext.broadcast(start))
        models = table_of(docs.where(part == turn).select("text").mapInArrow(fit, "tokens long, parameters binary"), "models")
        few = models.repartition(AVERAGERS).mapInArrow(average, "tokens long, parameters binary").collect()
        if few:
            total = sum(r["tokens"] for r in few)
            start = sum(np.frombuffer(r["parameters"], dtype=np.float32).astype(np.float64) * (r["tokens"] / total)
                        for r in few).astype(np.float32)
    model.load(start[:size])
    return model


def score(docs: DataFrame, counts: DataFrame, words: Vocabulary, model: LogBilinear) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): one row per document.

    Frequent words are looked up in what every task has; the others of a document, counted by word, meet
    the table of counts in a join by word, of which none is frequent. A document's own sums ride
    along under a word no text can hold, so its row needs no second pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps((words, model)))
    schema = pa.schema([("row", pa.int64()), ("word", pa.string()), ("times", pa.int64()), ("class", pa.int32()),
                        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("base", pa.float64()), ("own", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lm = pickle.loads(shared.value)
        at = TaskContext.get().partitionId() << 40
        base_of = np.append(known.word_base, 0.0)  # place -1 is a word that isn't here
        within_of = np.append(known.word_within, 0.0)
        for b in text_slices(batches):
            tokens, sizes, place, classes = known.encode(text_bytes(b))
            starts = np.cumsum(sizes) - sizes
            lp = lm.log10_probabilities(lm.contexts(classes, sizes), classes)
            own = np.add.reduceat(lp + within_of[place], starts)
            base = np.add.reduceat(base_of[place], starts)
            here = np.add.reduceat((place >= 0).astype(np.int64), starts)
            n = len(sizes)
            rows = at + np.arange(n)
            at += n
            none = pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array([f" {r}" for r in rows.tolist()]), pa.array(np.zeros(n, dtype=np.int64)), none,
                 b.column("doc_id"), pa.array(sizes), pa.array(here), pa.array(base), pa.array(own)], schema=schema)
            unknown = np.flatnonzero(place < 0)
            if not len(unknown):
                continue
            flat = list(chain.from_iterable(tokens))
            doc = np.repeat(np.arange(n), sizes)[unknown]
            kind = {}
            pairs: Counter = Counter()
            for d, i, c in zip(doc.tolist(), unknown.tolist(), classes[unknown].tolist()):
                pairs[d, flat[i]] += 1
                kind[flat[i]] = c
            m = len(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[np.fromiter((d for d, _ in pairs), dtype=np.int64, count=m)]),
                 pa.array([w for _, w in pairs], pa.binary()).cast(pa.string()), pa.array(list(pairs.values()), pa.int64()),
                 pa.array([kind[w] for _, w in pairs], pa.int32()), *[pa.nulls(m, t) for t in schema.types[4:]]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        measure, "row long, word string, times long, class int, doc_id long, n_tokens long, known long, base double, own double")
    found = rows.join(counts, "word", "left")

    def of_class(values: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("class") + 1)
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / words.denominator)
    within = F.when(F.col("n").isNull(), of_class(words.unseen)).otherwise(
        F.log10(F.greatest(F.col("n") - DISCOUNT, F.lit(DISCOUNT))) + of_class(words.seen_offset))
    alone = F.col("class") == 0  # an end that no training text has
    return (found.select("row", "doc_id", "n_tokens",
                         F.coalesce("known", F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
                         F.coalesce("base", F.col("times") * base).alias("base_score"),
                         F.coalesce("own", F.when(alone, 0.0).otherwise(F.col("times") * within)).alias("score"))
            .groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
                                *[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")]).drop("row"))


def scored(docs: DataFrame, train: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document.

    Counts and model come from the documents that ``train`` selects, by default all that aren't held
    out. A null text is just its end, a null doc_id stays null, repeated rows each keep their row (and
    count as often), no rows give no rows; other columns of ``docs`` are ignored. With no training
    document every word is unknown.
    """
    learned = docs.where(~held_out(F.col("doc_id")) if train is None else train)
    counts = table_of(token_counts(learned), "counts")
    words = vocabulary(counts)
    model = trained(learned, words)
    return score(docs, counts, words, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
