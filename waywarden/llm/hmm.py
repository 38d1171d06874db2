"""Hidden Markov language model over words, trained with Baum-Welch.

Words are emitted through classes: the most frequent words have classes of
their own, the others share classes by a checksum of the word, and within a
class a word's probability is its corpus count plus one over the class total,
with one more place for words never seen. How many classes there are grows with
the square root of the vocabulary, so the table that every task needs stays
small, while the counts it is combined with cover the whole vocabulary.

1. Texts are tokenised once, in blocks of documents: a block has its own list
   of words and its tokens as numbers into it. Blocks are written.
2. Word counts of the training documents are summed over the blocks.
3. Blocks get the counts of their own words by a join on the word; their tokens
   become classes, and the sums that need counts are taken.
4. Each Baum-Welch step maps the blocks: expected starts, transitions and
   emissions are added up within a partition, then across partitions.
5. Each document gets its likelihood by the scaled forward recursion.

The recursions run over many segments at once: transfer matrices of segments
first, where a document has several, then the chain of segments of each
document, then inside segments.
Scales are kept as logarithms, so a text of any length has an exact
likelihood (up to rounding).
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import arrow_rows, discard, documents, written

STATES = 4
#: Baum-Welch ends when a step adds less than GAIN nats a token, and after STEPS at the latest.
STEPS, GAIN = 6, 0.01
#: Words with a class of their own and classes that the others share: at least so many, and in proportion to the square root of the vocabulary.
OWN, OWN_GROWTH = 4096, 16
SHARED, SHARED_GROWTH = 1024, 4
#: Places of a model's parameters that are summed in one row.
CHUNK = 1 << 13
SEGMENT = 256
PART = 1 << 18
BLOCK_BYTES = 8 << 20
FOLD, HELD_OUT = 7, 2
SMOOTH = 0.1
#: The end of a text; no word is empty.
END = b""

BLOCKS = "block long, words array<binary>, counts array<long>, low binary, high binary, doc_ids array<long>, lengths array<long>, held_out array<boolean>"


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; one without an id trains."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLD == HELD_OUT


class _Block:
    """Documents of a block: words in order of their first use, tokens as places among them."""

    def __init__(self):
        self.places: dict[bytes, int] = {END: 0}
        self.tokens, self.docs, self.size = [], [], 0

    def add(self, doc: int | None, text: str | None) -> None:
        raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
        ws, places = raw.split(), self.places
        for w in ws:
            if w not in places:
                places[w] = len(places)
        at = np.fromiter(map(places.__getitem__, ws), np.uint32, len(ws))
        self.tokens.append(np.append(at, np.uint32(0)))
        self.docs.append(doc)
        self.size += len(raw)

    def row(self, number: int) -> pa.RecordBatch:
        whole, out = np.concatenate(self.tokens), [held_out(d) for d in self.docs]
        lengths = np.array(list(map(len, self.tokens)))
        counts = np.bincount(whole[np.repeat(~np.array(out), lengths)], minlength=len(self.places))
        values = {
            "block": [number],
            "words": [list(self.places)],
            "counts": [counts],
            # in two planes: the upper one is nearly all zeros, as frequent words come first
            "low": [(whole & 0xFFFF).astype("<u2").tobytes()],
            "high": [(whole >> 16).astype("<u2").tobytes()],
            "doc_ids": [self.docs],
            "lengths": [lengths],
            "held_out": [out],
        }
        return pa.RecordBatch.from_arrays([pa.array(v, BLOCK_TYPES[c]) for c, v in values.items()], names=list(values))


BLOCK_TYPES = {
    "block": pa.int64(),
    "words": pa.list_(pa.binary()),
    "counts": pa.list_(pa.int64()),
    "low": pa.binary(),
    "high": pa.binary(),
    "doc_ids": pa.list_(pa.int64()),
    "lengths": pa.list_(pa.int64()),
    "held_out": pa.list_(pa.bool_()),
}


def _blocks(batches):
    number, block = TaskContext.get().partitionId() << 32, _Block()
    for b in batches:
        for at in range(0, len(b), 64):
            part = b.slice(at, 64)
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                block.add(doc, text)
                if block.size >= BLOCK_BYTES:
                    yield block.row(number)
                    number, block = number + 1, _Block()
    if block.docs:
        yield block.row(number)


@dataclass
class Model:
    """start (K), move (K, K), emit (C, K); own: class of frequent words."""

    own: dict[bytes, int]
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def class_numbers(vocabulary: int) -> tuple[int, int]:
    """(words with a class of their own, shared classes) for a vocabulary: both grow with it, as a model that every task holds can."""
    root = math.isqrt(vocabulary)
    return max(OWN, OWN_GROWTH * root), max(SHARED, SHARED_GROWTH * root)


def first_model(own: list[bytes], class_counts: np.ndarray, states: int = STATES) -> Model:
    """States that rarely change and emit classes by frequency, each bent its own way: a fixed start for training."""
    c = len(class_counts)
    bend = np.array([[zlib.crc32(f"{k}:{i}".encode()) / 2**32 for k in range(states)] for i in range(c)])
    emit = (class_counts[:, None] + SMOOTH) * (0.5 + bend)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model({w: i for i, w in enumerate(own)}, np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class _Steps:
    """Segments, longest first, token by token: alive[t] of them have a token t, and steps[t] are those tokens' classes."""

    def __init__(self, cls: np.ndarray, start: np.ndarray, size: np.ndarray):
        most = int(size[0]) if len(size) else 0
        self.alive = [int(a) for a in np.searchsorted(-size, -np.arange(most), side="left")]
        self.steps = [cls[start[:a] + t] for t, a in enumerate(self.alive)]


class _Segments:
    """A block's documents cut into segments of up to SEGMENT tokens, with the chain of each document.

    A document's first segment begins with the start distribution, so its
    recursion is one of vectors; the others need the product of their matrices
    before it is known what they begin with. Arrays have the states first and
    the segments last, so that each step works on long rows.
    """

    def __init__(self, cls: np.ndarray, lengths: np.ndarray):
        self.docs, begin = len(lengths), np.cumsum(lengths) - lengths
        size = np.minimum(SEGMENT, lengths)
        self.first_doc = np.argsort(-size, kind="stable")
        self.first = _Steps(cls, begin[self.first_doc], size[self.first_doc])
        more = -(-lengths // SEGMENT) - 1
        doc = np.repeat(np.arange(self.docs), more)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more) + 1
        size = np.minimum(SEGMENT, lengths[doc] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        self.doc, nth = doc[order], nth[order]
        self.rest = _Steps(cls, (begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(more) - more, more) + 1) * SEGMENT)[order], size[order])
        by_nth = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[by_nth], np.arange(1, int(more.max(initial=0)) + 2))
        self.rounds = [by_nth[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def begin(self, m: Model, keep: bool) -> tuple[list, list, np.ndarray, np.ndarray]:
        """The first segments' state distributions and emissions by token (kept if asked for), the last distribution and the likelihood's logarithm."""
        emit, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
        alphas, emitted = [], []
        state, product, log = np.empty((len(m.start), self.docs)), np.ones(self.docs), np.zeros(self.docs)
        for t, (a, cls) in enumerate(zip(self.first.alive, self.first.steps, strict=True)):
            e = emit.take(cls, axis=1)
            now = e * m.start[:, None] if t == 0 else e * (step @ state[:, :a])
            s = now.sum(axis=0)
            now /= s
            state[:, :a] = now
            product[:a] *= s
            if t % 8 == 7:
                log[:a] += np.log(product[:a])
                product[:a] = 1.0
            if keep:
                alphas.append(now)
                emitted.append(e)
        return alphas, emitted, state, log + np.log(product)

    def transfer(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """For each other segment the product of move and emission over its tokens, scaled, and the scale's logarithm."""
        k, n = len(m.start), len(self.doc)
        emit, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
        p, log = np.empty((k, k, n)), np.zeros(n)
        for t, (a, cls) in enumerate(zip(self.rest.alive, self.rest.steps, strict=True)):
            e = emit.take(cls, axis=1)
            if t == 0:
                p[:] = m.move[:, :, None]
                p *= e
            else:
                now = np.matmul(step, p[:, :, :a])
                now *= e
                p[:, :, :a] = now
            if t % 8 == 7 or t == SEGMENT - 1:
                s = p[:, :, :a].max(axis=(0, 1))
                p[:, :, :a] /= s
                log[:a] += np.log(s)
        return p, log

    def forward(self, m: Model, first: tuple, p: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state distribution before each other segment, and each document's log likelihood."""
        state, total = np.empty((len(m.start), self.docs)), np.empty(self.docs)
        state[:, self.first_doc], total[self.first_doc] = first[2], first[3]
        before = np.empty((len(m.start), len(self.doc)))
        for at in self.rounds:
            d = self.doc[at]
            before[:, at] = state[:, d]
            now = np.einsum("kn,kln->ln", state[:, d], p[:, :, at])
            s = now.sum(axis=0)
            state[:, d] = now / s
            total[d] += np.log(s) + log[at]
        return before, total

    def likelihoods(self, m: Model) -> np.ndarray:
        return self.forward(m, self.begin(m, False), *self.transfer(m))[1]

    def expect(self, m: Model, counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> float:
        """Adds the expected starts, moves and emissions; returns the log likelihood."""
        first, (p, log) = self.begin(m, True), self.transfer(m)
        before, total = self.forward(m, first, p, log)
        behind, state = np.empty((len(m.start), len(self.doc))), np.ones((len(m.start), self.docs))
        for at in reversed(self.rounds):
            d = self.doc[at]
            behind[:, at] = state[:, d]
            now = np.einsum("kln,ln->kn", p[:, :, at], state[:, d])
            state[:, d] = now / now.max(axis=0)
        self._back(m, counts, self.first, first[0], first[1], state[:, self.first_doc], None)
        if len(self.doc):
            emit, step = np.ascontiguousarray(m.emit.T), np.ascontiguousarray(m.move.T)
            alphas, emitted, alpha = [], [], before
            for a, cls in zip(self.rest.alive, self.rest.steps, strict=True):
                emitted.append(emit.take(cls, axis=1))
                alpha = step @ alpha[:, :a]
                alpha *= emitted[-1]
                alpha /= alpha.sum(axis=0)
                alphas.append(alpha)
            self._back(m, counts, self.rest, alphas, emitted, behind, before)
        return float(total.sum())

    @staticmethod
    def _back(m: Model, counts: tuple, g: _Steps, alphas: list, emitted: list, beta: np.ndarray, before: np.ndarray | None) -> None:
        """Adds what the backward recursion from beta tells; before is what segments begin with, None for those at a document's start."""
        starts, moves, emits = counts
        for t in range(len(alphas) - 1, -1, -1):
            a = g.alive[t]
            alpha = alphas[t]
            gamma = alpha * beta[:, :a]
            gamma /= gamma.sum(axis=0)
            prior = alphas[t - 1][:, :a] if t else before
            alphas[t] = gamma
            if prior is None:
                starts += gamma.sum(axis=1)
                break
            out = emitted[t] * beta[:, :a]
            back = m.move @ out
            moves += (prior / (prior * back).sum(axis=0)) @ out.T * m.move
            back /= back.max(axis=0)
            beta[:, :a] = back
        cls, gamma = np.concatenate(g.steps), np.concatenate(alphas, axis=1)
        for j in range(len(emits.T)):
            emits[:, j] += np.bincount(cls, weights=gamma[j], minlength=len(emits))


def _numpy(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    """A row's list as an array."""
    return batch.column(column).slice(i, 1).flatten().to_numpy(zero_copy_only=False)


def _parts(lengths: np.ndarray) -> list[slice]:
    """Ranges of documents with about PART tokens each, so that a block's recursions need little memory at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // PART)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True) if b > a]


def _coded(batch: pa.RecordBatch, i: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of a block's tokens and the lengths of its documents."""
    return np.frombuffer(batch.column("codes")[i].as_buffer(), code_type(classes)), _numpy(batch, "lengths", i)


def _expect(model: Model):
    def run(batches):
        c, k = model.emit.shape
        counts = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
        likelihood, seen = 0.0, 0
        for b in batches:
            for i in range(len(b)):
                (codes, lengths), keep = _coded(b, i, c), ~_numpy(b, "held_out", i)
                ends = np.cumsum(lengths)
                for part in _parts(lengths):
                    mine, train = codes[ends[part.start] - lengths[part.start] : ends[part.stop - 1]], keep[part]
                    mine = mine[np.repeat(train, lengths[part])].astype(np.int32)
                    if len(mine):
                        likelihood += _Segments(mine, lengths[part][train]).expect(model, counts)
                        seen += len(mine)
        if seen:
            flat = np.concatenate([[likelihood, seen], counts[0], counts[1].ravel(), counts[2].ravel()])
            chunks = [(at // CHUNK, TaskContext.get().partitionId(), flat[at : at + CHUNK].tobytes()) for at in range(0, len(flat), CHUNK)]
            yield pa.RecordBatch.from_pylist([dict(zip(("chunk", "part", "sums"), x, strict=True)) for x in chunks], schema=SUMS)

    return run


SUMS = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("sums", pa.binary())])


def _add(batches):
    """The chunks of a partition, which has all rows of its chunks in order of parts, each added up."""
    chunk, total = None, None
    for b in batches:
        for n, sums in zip(b.column("chunk").to_pylist(), b.column("sums").to_pylist(), strict=True):
            values = np.frombuffer(sums)
            if n != chunk:
                if chunk is not None:
                    yield pa.RecordBatch.from_pylist([{"chunk": chunk, "sums": total.tobytes()}], schema=pa.schema([SUMS.field(0), SUMS.field(2)]))
                chunk, total = n, np.zeros(len(values))
            total = total + values
    if chunk is not None:
        yield pa.RecordBatch.from_pylist([{"chunk": chunk, "sums": total.tobytes()}], schema=pa.schema([SUMS.field(0), SUMS.field(2)]))


def baum_welch(coded: DataFrame, model: Model, steps: int = STEPS, gain: float = GAIN) -> tuple[Model, list[float]]:
    """The model after as many steps as pay, and the log likelihood per token before each.

    Each partition adds up its blocks' expected counts; chunks of these are
    added across partitions in order of their numbers, one row at a time, and
    what comes to the driver is one number for each parameter.
    """
    c, k = model.emit.shape
    trace = []
    for _ in range(steps):
        part = coded.select("codes", "lengths", "held_out").mapInArrow(_expect(model), "chunk long, part long, sums binary")
        sums = part.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(_add, "chunk long, sums binary").collect()
        flat = np.zeros(2 + k + k * k + c * k)
        for r in sums:
            values = np.frombuffer(bytes(r["sums"]))
            flat[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(values)] = values
        if not flat[1]:
            break
        trace.append(flat[0] / flat[1])
        if len(trace) > 1 and trace[-1] - trace[-2] < gain:
            break  # the model that was just looked at stays
        start = flat[2 : 2 + k] + SMOOTH
        move = flat[2 + k : 2 + k + k * k].reshape(k, k) + SMOOTH
        # what a state emits is smoothed towards what the corpus emits, so each class can be emitted
        emit = flat[2 + k + k * k :].reshape(c, k)
        share = (emit.sum(axis=1) + SMOOTH) / (emit.sum() + SMOOTH * c)
        emit = emit + SMOOTH * c * share[:, None]
        model = Model(model.own, start / start.sum(), move / move.sum(axis=1)[:, None], emit / emit.sum(axis=0))
    return model, trace


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


CODED = "doc_ids array<long>, held_out array<boolean>, lengths array<long>, n_known array<long>, base array<double>, inner array<double>, codes binary"


def code_type(classes: int) -> str:
    return "<u2" if classes <= 1 << 16 else "<u4"


def _code(own: int, total: int, distinct: int, class_count: np.ndarray, class_words: np.ndarray):
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        b = block.combine_chunks().to_batches()[0]  # a block is a row
        # every word of the block has a row, whether the corpus knows it or not
        at = known["pos"].to_numpy()
        counts, cls = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        counts[at], cls[at] = known["c"].to_numpy(), known["cls"].to_numpy()
        low, high = (np.frombuffer(b.column(c)[0].as_buffer(), "<u2") for c in ("low", "high"))
        tokens, lengths = low.astype(np.uint32) | high.astype(np.uint32) << 16, _numpy(b, "lengths", 0)
        base = np.log10((counts + 1) / (total + distinct + 1))
        # within a class; a word with a class of its own is certain there
        inner = np.where(cls < own, 0.0, np.log10((counts + 1) / (class_count[cls] + class_words[cls] + 1)))
        starts = np.cumsum(lengths) - lengths
        by_doc = lambda v: np.add.reduceat(v[tokens], starts)
        columns = [lengths, by_doc((counts > 0).astype(np.int64)), by_doc(base), by_doc(inner)]
        made = [b.column("doc_ids"), b.column("held_out"), *[pa.array([v]) for v in columns], pa.array([cls.astype(code_type(len(class_count)))[tokens].tobytes()], pa.binary())]
        return pa.table(made, names=[x.split()[0] for x in CODED.split(", ")])

    return run


def _score(model: Model):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                codes, lengths = _coded(b, i, len(model.emit))
                ends, logs = np.cumsum(lengths), []
                for part in _parts(lengths):
                    mine = codes[ends[part.start] - lengths[part.start] : ends[part.stop - 1]].astype(np.int32)
                    logs.append(_Segments(mine, lengths[part]).likelihoods(model))
                flat = lambda c, i=i, b=b: b.column(c).slice(i, 1).flatten()
                score_ = _numpy(b, "inner", i) + np.concatenate(logs) / np.log(10)
                yield pa.RecordBatch.from_arrays([flat("doc_ids"), flat("held_out"), pa.array(lengths), flat("n_known"), flat("base"), pa.array(score_)], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score(df: DataFrame, states: int = STATES, steps: int = STEPS) -> tuple[DataFrame, Model, list[float]]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df; the model; its training's trace.

    Null and empty texts are the end alone. Rows of one id are documents of
    their own. With nothing to train on, all classes are as likely.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = df.sparkSession
    with arrow_rows(spark, 512):
        blocks = written(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    spread = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counted = written(spread.groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0"), "counts")
    size = counted.agg(F.sum("c").alias("n"), F.count("*").alias("v")).head()
    total, distinct = size["n"] or 0, size["v"]
    # a row for each class comes to the driver: the square root of the vocabulary, times a number
    most, n_shared = class_numbers(distinct)
    frequent = {bytes(r["word"]): r["c"] for r in counted.orderBy(F.desc("c"), "word").limit(most).collect()}
    own = sorted(frequent)
    places = spark.createDataFrame([(bytearray(w), i) for i, w in enumerate(own)], "word binary, place int")
    shared = (len(own) + F.crc32("word") % n_shared).cast("int")
    vocab = counted.join(places, "word", "left").select("word", "c", F.coalesce("place", shared).alias("cls"))
    per = vocab.filter(F.col("cls") >= len(own)).groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    class_count, class_words = np.zeros(len(own) + n_shared), np.zeros(len(own) + n_shared)
    for r in per:
        class_count[r["cls"]], class_words[r["cls"]] = r["c"], r["n"]
    counts = class_count.copy()
    counts[: len(own)] = [frequent[w] for w in own]
    # a block meets the counts of its own words once; from then on its tokens are classes
    found = spread.select("block", "pos", "word").join(vocab, "word", "left").select("block", "pos", F.coalesce("c", F.lit(0).cast("long")).alias("c"), F.coalesce("cls", shared).alias("cls"))
    code = _code(len(own), total, distinct, class_count, class_words)
    both = blocks.drop("counts", "words").withColumnRenamed("block", "number").groupBy("number").cogroup(found.groupBy("block"))
    coded = written(both.applyInArrow(lambda block, known: code(block, known), CODED), "coded")
    discard(blocks, counted)
    with arrow_rows(spark, 1):  # a row is a block
        model, trace = baum_welch(coded, first_model(own, counts, states), steps)
        out = written(coded.mapInArrow(_score(model), SCORES), "scores")
    discard(coded)
    return out.withColumn("train_tokens", F.lit(total).cast("long")), model, trace


def op3(spark, sf_dir):
    scored, _, _ = score(documents(spark, sf_dir))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
