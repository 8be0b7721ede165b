"""A gated recurrent language model in numpy, trained and scored over whole documents.

Words outside the network's vocabulary are one class of their own, inside which a word is as likely as its
add-one training count; so every text has a probability, and the counts of the whole corpus bear on it. The
softmax is factored: a class by the state, then a word among its class. Documents run side by side in
lanes, a window of steps at a time; the state is carried from window to window and set to zero where a document starts,
so a document of any length is scored whole, and gradients are cut at window edges.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, repeated, slices, table, words_of, written

#: The network's words, and the words whose counts every task knows; the counts of others are joined.
WORDS, KNOWN = 2048, 131072
HIDDEN, CLASSES = 16, 30
#: One lane count at every size of input: it sets how many steps a token the model learns in.
LANES, STEPS = 256, 16
RATE = 0.15
FOLDS, HELD = 7, 2
#: Shares of the training documents, by sixteenths, that successive rounds learn from; models are averaged after each.
ROUNDS = (1, 3, 12)
#: The token at a text's end, in tables of counts: no word is empty.
END_TOKEN = b""
END, OUT = 0, 1


def class_bounds(counts: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Starts of the classes over ids (end, out, words by falling count), and the end: words in classes of equal counts."""
    words = counts[2:].astype(np.float64)
    if not len(words):
        return np.array([0, 1, 2])
    share = (np.cumsum(words) - words / 2) / max(words.sum(), 1)
    group = np.minimum((share * classes).astype(int), classes - 1)
    starts = np.flatnonzero(np.r_[True, np.diff(group) > 0]) + 2
    return np.r_[0, 1, starts, len(counts)]


_ONES: dict[tuple, np.ndarray] = {}


#: Words of consecutive classes that are scored as one block: small classes cost more calls than products.
BLOCK_WORDS = 96


def class_blocks(bounds: np.ndarray) -> list[tuple[int, int, np.ndarray | None]]:
    """(first class, last class + 1, mask) of blocks of classes, end and out left out: a mask says which of a block's words are in which of its classes,
    None for a block of one class."""
    out, c = [], 2
    while c < len(bounds) - 1:
        d = c + 1
        while d < len(bounds) - 1 and bounds[d + 1] - bounds[c] <= BLOCK_WORDS:
            d += 1
        own = np.searchsorted(bounds, np.arange(bounds[c], bounds[d]), "right") - 1
        out.append((c, d, (own == np.arange(c, d)[:, None]).astype(np.float32) if d - c > 1 else None))
        c = d
    return out


def exponentials(logits: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(logits - top), sums by row, and top: 0, or each row's largest logit where exp overflows or vanishes. mask: 0 for
    what a row leaves out."""
    key = logits.shape[1], logits.dtype
    if key not in _ONES:
        _ONES[key] = np.ones(*key)
    e = np.exp(logits)
    if mask is not None:
        e *= mask
    s = e @ _ONES[key]
    if s.max() < 1e37 and s.min() > 1e-30:
        return e, s, 0.0
    if mask is not None:
        logits = np.where(mask > 0, logits, -np.inf)
    top = logits.max(axis=1)
    e = np.exp(logits - top[:, None])
    return e, e @ _ONES[key], top


class Model:
    """Weights as float32 arrays; `flat` lists them. Start: the words' and classes' frequencies."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 1):
        rng, v = np.random.default_rng(seed), len(counts)
        self.hidden, self.bounds = hidden, class_bounds(counts)
        self.class_of, self.blocks = (np.searchsorted(self.bounds, np.arange(v), "right") - 1).astype(np.int16), class_blocks(self.bounds)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        c = np.maximum(counts.astype(np.float64), 0.5)
        mass = np.add.reduceat(c, self.bounds[:-1])
        self.x, self.u = small(v, 3 * hidden), small(hidden, 3 * hidden)
        self.x[:, :hidden] += 1.0  # keep the state at first
        self.wc, self.bc = small(hidden, len(mass)), np.log(mass / mass.sum()).astype(np.float32)
        self.ww, self.bw = small(v, hidden), np.log(c / mass[self.class_of]).astype(np.float32)

    def flat(self) -> list[np.ndarray]:
        return [self.x, self.u, self.wc, self.bc, self.ww, self.bw]

    def vector(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.flat()])

    def load(self, vector: np.ndarray) -> Model:
        at = 0
        for a in self.flat():
            a[...] = vector[at : at + a.size].reshape(a.shape)
            at += a.size
        return self

    def run(self, inputs: np.ndarray, keep: np.ndarray, h: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (steps, lanes, hidden) over a window, and the last. keep: 0 where a document starts.

        Inside, lanes are the last axis, so that each gate is one contiguous block. trace takes, by steps: the states before, the gates and the new state
        in one array, and what the reset gate multiplies.
        """
        n, ut, lanes = self.hidden, np.ascontiguousarray(self.u.T), inputs.shape[1]
        gates = np.ascontiguousarray(self.x[inputs].transpose(0, 2, 1))
        out, before = np.empty((2, len(inputs), n, lanes), np.float32)
        held, h = np.empty_like(before) if trace is not None else None, h.T
        a = np.empty((3 * n, lanes), np.float32)
        for t in range(len(inputs)):
            h = np.multiply(h, keep[t], out=before[t])
            np.matmul(ut, h, out=a)
            zr, new = gates[t, : 2 * n], gates[t, 2 * n :]
            zr += a[: 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            if trace is not None:
                held[t] = a[2 * n :]
            a[2 * n :] *= zr[n:]
            new += a[2 * n :]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=out[t])
            h *= zr[:n]
            h += new
        if trace is not None:
            trace.extend((before, gates, held))
        return np.ascontiguousarray(out.transpose(0, 2, 1)), h.T

    def log_probs(self, states: np.ndarray, targets: np.ndarray, back: bool = False):
        """Natural logs of the targets' probabilities; with back, the gradients of their negative sum as well."""
        cls = self.class_of[targets]
        order = np.argsort(cls, kind="stable")  # by class, so that a class's rows lie together
        edges = np.searchsorted(cls[order], np.arange(len(self.bounds)))
        states, targets, cls, every = states[order], targets[order], cls[order], np.arange(len(targets))
        logits = states @ self.wc
        logits += self.bc
        picked = logits[every, cls]
        e, s, top = exponentials(logits)
        found = picked - top - np.log(s)
        if back:
            d = np.multiply(e, (1 / s)[:, None], out=e)
            d[every, cls] -= 1
            dh, gww, gbw = d @ self.wc.T, np.zeros_like(self.ww), np.zeros_like(self.bw)
            gwc, gbc = states.T @ d, d.sum(axis=0)
        for c, d_, mask in self.blocks:
            lo, hi, first, last = self.bounds[c], self.bounds[d_], edges[c], edges[d_]
            if hi - lo < 2 or first == last:
                continue
            x, w = states[first:last], self.ww[lo:hi]
            logits = x @ w.T
            logits += self.bw[lo:hi]
            at, which = every[: last - first], targets[first:last] - lo
            picked = logits[at, which]
            e, s, top = exponentials(logits, None if mask is None else mask[cls[first:last] - c])
            found[first:last] += picked - top - np.log(s)
            if back:
                e *= (1 / s)[:, None]
                e[at, which] -= 1
                dh[first:last] += e @ w
                np.matmul(e.T, x, out=gww[lo:hi])
                np.sum(e, axis=0, out=gbw[lo:hi])
        out = np.empty_like(found)
        out[order] = found
        if not back:
            return out
        turned = np.empty_like(dh)
        turned[order] = dh
        return out, turned, (gwc, gbc, gww, gbw)


class Trainer:
    """Adagrad over windows; what it holds besides the model is one sum of squares for each weight."""

    def __init__(self, model: Model, rate: float = RATE):
        self.model, self.rate = model, rate
        self.squares = [np.full_like(a, 1.0) for a in model.flat()]

    def step(self, a: np.ndarray, squares: np.ndarray, grad: np.ndarray) -> None:
        squares += grad * grad
        a -= self.rate * grad / np.sqrt(squares)

    def rows(self, ids: np.ndarray, grad: np.ndarray) -> None:
        """A step of the inputs' rows that a window has."""
        squares = self.squares[0][ids] + grad * grad
        self.squares[0][ids] = squares
        self.model.x[ids] -= self.rate * grad / np.sqrt(squares)

    def window(self, inputs, targets, keep, use, h) -> tuple[np.ndarray, float]:
        """Learn from a window (steps, lanes); use: which targets count. Returns the last state and the log likelihood."""
        m, n, trace = self.model, self.model.hidden, []
        states, last = m.run(inputs, keep, h, trace)
        before, gates, held = trace
        flat, chosen = states.reshape(-1, n), np.flatnonzero(use.ravel())
        logs, dh, grads = m.log_probs(flat[chosen], targets.ravel()[chosen], back=True)
        d_out = np.zeros_like(flat)
        d_out[chosen] = dh
        d_out = np.ascontiguousarray(d_out.reshape(states.shape).transpose(0, 2, 1))
        # What doesn't depend on the gradient from later steps, for all steps at once.
        zs, rs, news = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        by_new = (1 - zs) * (1 - news * news)
        by_z = (before - news) * zs * (1 - zs)
        by_r = held * rs * (1 - rs)
        d_in, d_a, flow = np.empty_like(gates), np.empty_like(gates), np.zeros_like(before[0])
        for t in range(len(inputs) - 1, -1, -1):
            d = d_out[t]
            d += flow
            g, a = d_in[t], d_a[t]
            dn = np.multiply(d, by_new[t], out=g[2 * n :])
            np.multiply(d, by_z[t], out=g[:n])
            np.multiply(dn, by_r[t], out=g[n : 2 * n])
            a[: 2 * n] = g[: 2 * n]
            np.multiply(dn, rs[t], out=a[2 * n :])
            np.matmul(m.u, a, out=flow)
            d *= zs[t]
            flow += d
            flow *= keep[t]
        s = self.squares
        self.step(m.u, s[1], np.matmul(before, d_a.transpose(0, 2, 1)).sum(axis=0))
        for k, (a, grad) in enumerate(zip(m.flat()[2:], grads, strict=True)):
            self.step(a, s[2 + k], grad)
        ids = inputs.ravel().astype(np.int16)  # as _ids() has them: 16 bits sort by radix
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        grad = np.add.reduceat(d_in.transpose(0, 2, 1).reshape(-1, 3 * n)[order], starts, axis=0)
        self.rows(ids[starts].astype(np.int64), grad)
        return last, float(logs.sum())


def windows(docs: list[np.ndarray], lanes: int = LANES, steps: int = STEPS) -> Iterator[tuple]:
    """(inputs, targets, keep, use, doc, alive) for each window over a batch of documents' ids, steps by lanes.

    The longest document goes to the shortest lane first. A lane's documents lie one after the other in memory, so a window
    is one gather; lanes that are done are closed, and alive lists those that stay since the last window. doc: the
    document's number for each place. State carried along a lane starts anew where keep is 0.
    """
    sizes = np.array([len(d) for d in docs], np.int64)
    heap = [(0, i) for i in range(min(lanes, len(docs)))]
    own: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heap[0]
        heapq.heapreplace(heap, (load + int(sizes[d]), lane))
        own[lane].append(d)
    order = np.array([d for lane in own for d in lane], np.int64)
    if not len(order):
        return
    targets = np.concatenate([docs[d] for d in order])
    first = np.cumsum(sizes[order]) - sizes[order]
    inputs = np.r_[np.int32(END), targets[:-1]]
    keep = np.ones(len(targets), np.float32)
    inputs[first], keep[first] = END, 0
    doc = np.repeat(order, sizes[order])
    ends = np.cumsum([sizes[lane].sum() for lane in own])
    at, alive = ends - [sizes[lane].sum() for lane in own], np.arange(len(own))
    step = np.arange(steps)[:, None]
    last = len(targets) - 1
    while len(at):
        where = at + step
        use = where < ends
        where = np.minimum(where, last)
        yield inputs[where], targets[where], keep[where], use, doc[where], alive
        at = at + steps
        alive = np.flatnonzero(at < ends)
        at, ends = at[alive], ends[alive]


class Vocabulary:
    """The most frequent words' places and counts; ids of the network: end, out, then its words. Ids are kept in 16 bits."""

    def __init__(self, tokens: list[bytes], counts: list[int], end_count: int, out_count: int, net: int = WORDS):
        if net > 32_765:
            raise ValueError("a network has 32,765 words at most: its ids are 16-bit")
        self.place = {w: i for i, w in enumerate(tokens)}
        self.counts = np.array([*counts, 0], np.int64)  # the last: not here
        self.end_count, self.net = end_count, min(net, len(tokens))
        self.net_counts = np.array([end_count, out_count, *counts[: self.net]], np.int64)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, places: np.ndarray) -> np.ndarray:
        """With the end."""
        ids = np.where((places >= 0) & (places < self.net), places + 2, OUT)
        return np.r_[ids, END].astype(np.int32)


def held_out(doc_id):
    """crc32 of the id as text leaves HELD; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def count_words(texts: DataFrame) -> DataFrame:
    """(token, c) over all of `text`, an end for each row. Tasks add up their own counts first."""

    def count(batches: Iterator[pa.RecordBatch]):
        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        seen: Counter = Counter()
        for b in slices(batches, "text"):
            for text in b.column("text").to_pylist():
                seen.update(words_of(text))
                seen[END_TOKEN] += 1
            if len(seen) > 400_000:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return map_arrow(texts.select("text"), count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, n: int) -> list:
    """The n most frequent (token, c), ties by token. A histogram of counts in some thousand steps shows what can't be among
    them, so that tasks don't send n rows each."""
    step = F.floor(F.log(F.col("c").cast("double")) * 64).alias("s")
    sizes = counts.groupBy(step).agg(F.count("*").alias("k")).orderBy(F.desc("s")).collect()
    low, seen = 0, 0
    for s, k in sizes:
        low, seen = s, seen + k
        if seen >= n:
            break
    return counts.where(F.floor(F.log(F.col("c").cast("double")) * 64) >= low).orderBy(F.desc("c"), "token").limit(n).collect()


def summed(parts: DataFrame) -> np.ndarray:
    """The weighted mean of models, given as (block, weight, v) of float32 blocks: first sums among a few tasks each,
    then of those, so no task meets all models' blocks but the driver one model."""

    def add(batches):
        total, weight = {}, Counter()
        for b in batches:
            for k, w, v in zip(*(b.column(c).to_pylist() for c in ("block", "weight", "v")), strict=True):
                x = np.frombuffer(v, np.float32) * w if w else np.zeros(len(v) // 4)
                total[k] = total[k] + x if k in total else x.astype(np.float64)
                weight[k] += w
        rows = [(k, weight[k], (x / max(weight[k], 1e-9)).astype(np.float32).tobytes()) for k, x in total.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["block", "weight", "v"])

    schema = "block int, weight double, v binary"
    some = map_arrow(parts.repartition("block", "salt").select("block", "weight", "v"), add, schema)
    whole = map_arrow(some.repartition("block"), add, schema)
    return np.concatenate([np.frombuffer(r["v"], np.float32) for r in whole.orderBy("block").collect()])  # one model


BLOCK = 8192


def prepared(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A written table of every row (doc_id, text, held_out, slice), tokenised once: the network's ids with the end (16-bit), what
    the known words add up to, and the others with their numbers."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]):
        words = known.value
        logs = np.log10(words.counts + 1.0)
        end = np.log10(words.end_count + 1.0)
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            lists = [words_of(t) for t in texts]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            tokens = list(chain.from_iterable(lists))
            p, doc = words.places(tokens), np.repeat(np.arange(len(lists)), sizes)
            sums = lambda where, of=None: np.bincount(doc[where], of, len(lists))  # noqa: B023, E731
            missing, other = p < 0, (p >= words.net) | (p < 0)  # -1 reads the last count, 0
            ids = np.full(len(p) + len(lists), END, "<i2")
            ids[np.arange(len(p)) + doc] = np.where(other, OUT, p + 2)
            rare, times, ends, at = [], [], [0], np.flatnonzero(missing)
            edges = np.searchsorted(at, np.cumsum(sizes)).tolist()
            at, first = at.tolist(), 0
            for last in edges:
                if last > first:
                    seen = Counter([tokens[i] for i in at[first:last]])
                    rare.extend(seen)
                    times.extend(seen.values())
                ends.append(len(rare))
                first = last
            logs_p = logs[p]
            offsets = np.r_[0, np.cumsum(sizes + 1)] * 2
            columns = [
                pa.array([key_of(t) for t in texts], pa.int64()), pa.array(sizes + 1), pa.array(sizes - sums(missing) + (words.end_count > 0)),
                pa.array(sums(slice(None), logs_p) + end), pa.array(sums(other, logs_p[other]) + 0.0), pa.array(sums(other).astype(np.int64)),
                pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)]),
            ]
            pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int32())], names=["token", "times"])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("slice"), *columns], names=["doc_id", "held_out", "slice", *NAMES])

    return written(map_arrow(rows, prepare, f"doc_id {id_type}, held_out boolean, slice int, h long, n_tokens long, known long, logs double, out_logs double, n_out long, ids binary, rare array<struct<token: binary, times: int>>"))


NAMES = ("h", "n_tokens", "known", "logs", "out_logs", "n_out", "ids", "rare")
MAIN = ("doc_id", "held_out", "h", "n_tokens", "known", "logs", "out_logs", "n_out")
#: Bytes of ids that the network learns from as one batch, and that it scores as one, that many steps at a time: state is carried through whole
#: documents, so neither changes a score.
BATCH, SCORED, SCORED_STEPS = 3 << 20, 4 << 20, 32


def _ids(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2").astype(np.int32) for x in batch.column("ids").to_pylist()]


def learn(table_: DataFrame, vocabulary: Vocabulary, rounds: tuple = ROUNDS) -> np.ndarray:
    """A trained model's vector from all of a table (ids, slice in 0..15): each round's tasks start from the mean of the
    last one's models and go once over the documents of their slices."""
    spark = table_.sparkSession
    model = Model(vocabulary.net_counts)
    counts, first = vocabulary.net_counts, 0
    for share in rounds:
        own = table_.where((F.col("slice") >= first) & (F.col("slice") < first + share)).select("ids")
        first += share
        start = spark.sparkContext.broadcast(model.vector())

        def work(batches: Iterator[pa.RecordBatch], start=start):
            own_model = Model(counts).load(start.value)
            trainer, tokens = Trainer(own_model), 0
            with np.errstate(over="ignore"):
                for b in slices(batches, "ids", BATCH):
                    h = np.zeros((LANES, own_model.hidden), np.float32)
                    for inputs, targets, keep, use, _, stay in windows(_ids(b)):
                        h, _ = trainer.window(inputs, targets, keep, use, h[stay])
                        tokens += int(use.sum())
            if tokens:
                v = own_model.vector()
                blocks = [v[i : i + BLOCK].tobytes() for i in range(0, len(v), BLOCK)]
                n, salt = len(blocks), int(tokens) % 32
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([float(tokens)] * n), pa.array(blocks, pa.binary())],
                    names=["block", "salt", "weight", "v"],
                )

        parts = written(map_arrow(own, work, "block int, salt int, weight double, v binary"))
        if not parts.isEmpty():
            model.load(summed(parts))
    return model.vector()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; other columns aren't read.

    Learns from the rows that aren't held out and scores all. Null texts are empty: one token, the end. Null and
    repeated ids and repeated rows are kept, each with its own score. With nothing to learn from, every word is as
    likely as an unseen one. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(sum(ROUNDS))).cast("int"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = written(count_words(train))
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END_TOKEN), F.col("c"))), F.lit(0))).first()
    top = most_frequent(counts.where(F.col("token") != F.lit(END_TOKEN)), KNOWN)
    tokens, c = [bytes(r["token"]) for r in top], [r["c"] for r in top]
    inside = sum(c[:WORDS])
    vocabulary = Vocabulary(tokens, c, ends, n - ends - inside)
    out_types = v - (ends > 0) - vocabulary.net
    out_total = float(n - ends - inside + out_types + 1)
    ready = prepared(rows, vocabulary)
    net_counts = vocabulary.net_counts
    weights = spark.sparkContext.broadcast(learn(ready.where(~F.col("held_out")), vocabulary))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]):
        model = Model(net_counts).load(weights.value)
        for b in slices(batches, "ids", SCORED):
            total = np.zeros(b.num_rows)
            h = np.zeros((LANES, model.hidden), np.float32)
            with np.errstate(over="ignore"):
                for inputs, targets, keep, use, doc, stay in windows(_ids(b), steps=SCORED_STEPS):
                    states, h = model.run(inputs, keep, h[stay])
                    chosen = use.ravel()
                    found = model.log_probs(states.reshape(-1, model.hidden)[chosen], targets.ravel()[chosen])
                    total += np.bincount(doc.ravel()[chosen], found, len(total))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in MAIN), pa.array(total / np.log(10))], names=[*MAIN, "net"])

    main = map_arrow(ready.select(*MAIN, "ids"), scored, f"doc_id {id_type}, held_out boolean, h long, n_tokens long, known long, logs double, out_logs double, n_out long, net double")
    # Repeated rows count once here, and as often as they occur at the end.
    main = main.groupBy("doc_id", "h").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("held_out", "n_tokens", "known", "logs", "net", "out_logs", "n_out")))
    rest = ready.select("doc_id", "h", F.explode("rare").alias("r")).select("doc_id", "h", "r.token", "r.times").join(counts, "token")
    rest = rest.groupBy("doc_id", "h").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + F.lit(1.0))).alias("rare_logs"))
    rest = rest.withColumnsRenamed({"doc_id": "_d", "h": "_h"})
    both = main.join(rest, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    some = lambda c: F.coalesce(F.col(c) / F.col("copies"), F.lit(0.0))
    base = F.col("logs") + some("rare_logs") - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    own = F.col("net") + F.col("out_logs") + some("rare_logs") - F.col("n_out") * F.log10(F.lit(out_total))
    both = both.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.round(some("rare_known"))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"), own.alias("score"), "copies",
    )
    return repeated(both, F.col("copies"), "_copy").drop("_copy", "copies")


def key_of(text: str | None) -> int:
    """64 bits of a text, signed; with the id it names a row."""
    x = xxhash.xxh64_intdigest((text or "").encode("utf-8", "surrogatepass"))
    return x - (1 << 64) if x >> 63 else x


def op1_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability."""
    return score(table(spark, sf_dir, "documents"))
