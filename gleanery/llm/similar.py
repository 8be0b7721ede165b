"""Near-duplicates by the similarity of word shingles: SimHash fingerprints behind a pigeonring filter, then the sets themselves.

At a similarity of 0.8 two 128-bit fingerprints differ in some twenty bits, so no equal segments can gather them without losses. Texts meet at
shingles instead: sets of n shingles that reach the similarity share one of the first n - ceil(0.8 n) + 1 in any order that all texts
use, and the order puts frequent shingles last. Of what meets, the pigeonring filter drops most: cut into m segments around a ring, fingerprints
within t bits have a chain of segments from some start whose first l segments differ in at most l * t / m bits, for every l. Then comes the
whole distance. What is left hangs together in groups, and inside each the sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, components, forget, lower_ascii, map_arrow, slices, words_of, written

WIDTH = 5
#: Similarity as a fraction: shared shingles by shingles of either.
NUMERATOR, DENOMINATOR = 4, 5
#: Bits in which fingerprints of similar texts may differ, by 64-bit words: five deviations above what a similarity of 0.8 lets expect, and six for two
#: words. Of two texts that have nothing in common one word lets 3 % pass, which in large tables joins most texts that meet into one group; two let 0.03 %.
BITS = {1: 24, 2: 44}
WORDS = 2
#: Segments of eight bits.
CHAIN = 4
#: Counters for shingles' frequencies. They decide the order of shingles and how large meeting places are dealt out, never a result.
COUNTERS = 1 << 18
#: Texts that one task holds at a meeting place, and shingles that one holds of a group; more are dealt out in pairs of blocks.
BLOCK, GROUP = 100_000, 4_000_000
#: Keys that a task remembers so as not to send copies again.
SEEN = 1 << 16
#: 64-bit words of the bitmap of keys that have met others. It spares the rest the join; a full one spares nothing.
BITMAP = 1 << 18
#: 64-row words of the bitmap of rows that go, as many as are broadcast. More are joined, which shuffles all rows.
GONE = 1 << 20
#: The setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _lean(spark: SparkSession):
    """Queries that end inside leave no shuffle files: what they wrote is read again, and else these stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit hashes stirred by shifts and odd factors."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of k words, A-Z lower-cased; of fewer words the whole sequence; none without words."""
    words = words_of(text)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - k + 1, min(len(words), 1))
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = _mix(out + h[i : i + n] + np.uint64(i + 1))
    return np.unique(out)


def fingerprint_of(shingles: np.ndarray) -> np.ndarray:
    """WORDS words of 64 bits. Bit i is 1 if it is in over half of the hashes; each further word has hashes of its own, stirred from the former's."""
    out = np.zeros(WORDS, np.uint64)
    for w in range(WORDS):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(shingles), 65536):
            votes += np.unpackbits(shingles[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(votes * 2 > len(shingles), bitorder="little").view("<u8")[0]
        if w + 1 < WORDS:
            shingles = _mix(shingles + np.uint64(0x9E3779B97F4A7C15))
    return out


def prefix_length(n: int) -> int:
    return n + n * NUMERATOR // -DENOMINATOR + 1


def may_be_similar(fp: np.ndarray, n: np.ndarray, fp2, n2) -> np.ndarray:
    """Whether numbers of shingles allow the similarity, a chain of segments keeps its budgets, and the whole distance does. Fingerprints are a word or a
    row of words each; fp2 may be a single one."""
    ok = np.minimum(n, n2) * DENOMINATOR >= np.maximum(n, n2) * NUMERATOR
    at, words = np.flatnonzero(ok), 1 if fp.ndim == 1 else fp.shape[1]
    bits, m = BITS[words], 8 * words
    diff = np.bitwise_count(np.ascontiguousarray(fp[at] ^ (fp2 if np.ndim(fp2) < fp.ndim else fp2[at])).view(np.uint8).reshape(-1, m)).astype(np.int16)
    spent = np.zeros_like(diff)
    alive = np.ones(diff.shape, bool)
    for l in range(CHAIN):  # noqa: E741
        spent += np.roll(diff, -l, axis=1)
        alive &= spent * m <= (l + 1) * bits
    ok[at] = alive.any(axis=1) & (diff.sum(axis=1) <= bits)
    return ok


def _fingerprints(t) -> np.ndarray:
    """A row of words for each row of a table."""
    return np.column_stack([np.ascontiguousarray(t.column(c).to_numpy()).view(np.uint64) for c in ("fp", "fp2")])


def _new(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray | None = None):
    """(key, shingles) of each text, of those in a bitmap if there is one, that the task has not met of late; texts without words are left out."""
    seen = set()
    for b in slices(batches, "text"):
        if bitmap is not None:
            k = np.ascontiguousarray(b.column("key").to_numpy()).view(np.uint64)
            b = b.filter(pa.array((bitmap[k >> np.uint64(46)] >> (k & np.uint64(63)) & np.uint64(1)).astype(bool)))
        for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
            if key in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(key)
            shingles = shingle_set(text)
            if len(shingles):
                yield key, shingles


def frequencies(texts: DataFrame) -> np.ndarray:
    """Eight times the binary logarithm of each counter, a byte each: shingles of all texts share COUNTERS of them."""

    def count(batches):
        total, held, size = np.zeros(COUNTERS, np.int64), [], 0
        for _, s in _new(batches):
            held.append((s & np.uint64(COUNTERS - 1)).astype(np.int32))
            size += len(s)
            if size > COUNTERS:
                total += np.bincount(np.concatenate(held), minlength=COUNTERS)
                held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65536):
            part = at[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["slot", "n"])

    sums = map_arrow(texts, count, "slot int, n long").groupBy("slot").agg(F.round(F.log2(F.sum("n")) * 8).cast("int").alias("level"))
    got = sums.toArrow()
    levels = np.zeros(COUNTERS, np.uint16)
    levels[got.column("slot").to_numpy()] = got.column("level").to_numpy()
    return levels


def meetings(texts: DataFrame, levels: np.ndarray, block: int = BLOCK) -> DataFrame:
    """(place, key, fp, fp2, n): where each text meets those that may be similar. A place is a shingle of its prefix; one that many
    texts have becomes a place for each pair of blocks of texts."""
    used = levels[levels > 0]
    usual = 2.0 ** (np.median(used) / 8) if len(used) else 0.0
    blocks = np.maximum(np.ceil((2.0 ** (levels / 8) - usual) / block), 1).astype(np.int64)

    def send(batches):
        parts, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["place", "key", "fp", "fp2", "n"])

        for key, s in _new(batches):
            slot = (s & np.uint64(COUNTERS - 1)).astype(np.int64)
            first = np.lexsort((s, levels[slot]))[: prefix_length(len(s))]
            place, many = s[first], blocks[slot[first]]
            for i in np.flatnonzero(many > 1).tolist():
                m = int(many[i])
                mine, other = key % m, np.arange(m)
                pair = (np.minimum(mine, other) * m + np.maximum(mine, other) + 1).astype(np.uint64)
                tiles = _mix(place[i] + pair * np.uint64(0x9E3779B97F4A7C15))
                place[i], place = tiles[0], np.concatenate([place, tiles[1:]])
            k = len(place)
            parts.append((place.view(np.int64), np.full(k, key, np.int64), *(np.full(k, w) for w in fingerprint_of(s).view(np.int64)), np.full(k, len(s), np.int32)))
            size += k
            if size >= 65536:
                yield batch()
                parts, size = [], 0
        if parts:
            yield batch()

    return map_arrow(texts, send, "place long, key long, fp long, fp2 long, n int")


def spanning(n: int, links) -> tuple[list, list]:
    """Links that join all of 0..n-1 that links(i, others) joins: who is found need not be found again."""
    left, out_a, out_b = np.arange(n), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = links(i, left)
            found = left[near]
            out_a.append(np.full(len(found), i))
            out_b.append(found)
            queue.extend(found.tolist())
            left = left[~near]
    return out_a, out_b


def _whole(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by columns, cut only where these change."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        k = np.column_stack([held.column(c).to_numpy() for c in by])
        if not len(k):
            continue
        last = np.flatnonzero(np.any(k != k[-1], axis=1))
        if len(last):
            yield held.slice(0, last[-1] + 1)
            held = held.slice(last[-1] + 1).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _edges(a: list, b: list) -> pa.RecordBatch:
    empty = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(empty + x).astype(np.int64)) for x in (a, b)], names=["a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the texts which pass the filter at each place."""
    for t in _whole(batches, ["place"]):
        place, key, n = (t.column(c).to_numpy() for c in ("place", "key", "n"))
        n, fp = n.astype(np.int64), _fingerprints(t)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.r_[starts, len(place)])
        i = starts[sizes == 2]
        i = i[key[i] != key[i + 1]]
        i = i[may_be_similar(fp[i], n[i], fp[i + 1], n[i + 1])]
        out_a, out_b = [key[i]], [key[i + 1]]
        for i, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own, at = np.unique(key[i : i + size], return_index=True)
            f, m = fp[i : i + size][at], n[i : i + size][at]
            for x, y in zip(*spanning(len(own), lambda j, left, f=f, m=m: may_be_similar(f[left], m[left], f[j], m[j])), strict=True):
                out_a.append(own[x])
                out_b.append(own[y])
        yield _edges(out_a, out_b)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join the similar texts of each tile of a group."""
    for t in _whole(batches, ["root", "tile"]):
        group = np.column_stack([t.column(c).to_numpy() for c in ("root", "tile")])
        starts = np.flatnonzero(np.r_[True, np.any(group[1:] != group[:-1], axis=1)])
        for i, size in zip(starts.tolist(), np.diff(np.r_[starts, len(group)]).tolist(), strict=True):
            rows = t.slice(i, size)
            key, at = np.unique(rows.column("key").to_numpy(), return_index=True)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles").take(pa.array(at)).combine_chunks()]
            fp = _fingerprints(rows)[at]
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            names, local = np.unique(np.concatenate(sets), return_inverse=True)
            local, mark = np.split(local.astype(np.int32), np.cumsum(n)[:-1]), np.zeros(len(names), bool)
            del sets, names

            def links(j, left, fp=fp, n=n, local=local, mark=mark):
                ok = may_be_similar(fp[left], n[left], fp[j], n[j])
                mark[local[j]] = True
                for x in np.flatnonzero(ok).tolist():
                    o = left[x]
                    ok[x] = int(np.count_nonzero(mark[local[o]])) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * int(n[j] + n[o])
                mark[local[j]] = False
                return ok

            a, b = spanning(len(key), links)
            yield _edges([key[x] for x in a], [key[x] for x in b])


def groups(texts: DataFrame, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(node, root) of each key of (key, text) that is similar to another: root is the least key reachable. Rows of equal keys hold equal words."""
    places = meetings(texts, frequencies(texts), block).repartition("place").sortWithinPartitions("place")
    wide = components(map_arrow(places, _met, "a long, b long"), "a", "b")
    wide = written(wide.select(F.col("node").alias("key"), "root").distinct())

    words = wide.groupBy(F.shiftrightunsigned("key", 46).cast("int").alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP, np.uint64)
    bitmap[words.column("slot").to_numpy()] = np.ascontiguousarray(words.column("bits").to_numpy()).view(np.uint64)

    def gather(batches):
        held, size = [], 0

        def batch():
            key, fp, shingles = zip(*held, strict=True)
            words = np.array(fp).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(shingles, pa.binary())], names=["key", "fp", "fp2", "shingles"])

        for key, s in _new(batches, bitmap):
            held.append((key, fingerprint_of(s), s.tobytes()))
            size += s.nbytes
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    sets = map_arrow(texts, gather, "key long, fp long, fp2 long, shingles binary")
    sets = written(sets.join(wide, "key").select("root", "key", "fp", "fp2", "shingles"))
    forget(wide)
    size = sets.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles")) / (8 * group)).cast("long").alias("blocks"))
    rows = sets.join(size, "root").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")))
    pair = lambda j: F.least(F.col("mine"), j) * F.col("blocks") + F.greatest(F.col("mine"), j)
    rows = rows.select("root", "key", "fp", "fp2", "shingles", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("tile"))
    rows = rows.repartition("root", "tile").sortWithinPartitions("root", "tile")
    out = components(map_arrow(rows, _compared, "a long, b long"), "a", "b").distinct()
    forget(sets)
    return out


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows whose uid is not among gone's. Numbers of rows are dense in each partition, so 64 of them share one word of a bitmap, which is broadcast: rows,
    which hold the texts, are not shuffled."""
    words = gone.groupBy(F.shiftright("uid", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(uid & 63 as int))")).alias("_bits"))
    words = written(words)
    if words.count() <= GONE:
        words = F.broadcast(words)
    out = rows.join(words, F.shiftright("uid", 6) == F.col("_word"), "left")
    return out.where("_bits is null or shiftrightunsigned(_bits, cast(uid & 63 as int)) & 1 = 0").drop("_word", "_bits")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of near-duplicates, its columns as they are, whatever their names: that of the least id, nulls last; of
    equal ids that of the least hash of its words, then of its text. Texts are linked if their sets of five-word shingles (A-Z lower-cased) have
    a similarity of 0.8 or more; of fewer words the whole sequence is the one shingle. Null and empty texts and texts without words are one group.
    Repeated rows are copies of each other. An empty table gives an empty result. Texts whose words have the same 64-bit hash count as equal.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.xxhash64(F.trim(F.regexp_replace(lower_ascii(text), r"[\x20\x09-\x0D]+", " ")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    with _lean(docs.sparkSession):
        rows = written(docs.select(row.alias("row"), key.alias("key"), F.monotonically_increasing_id().alias("uid")))
        roots = groups(rows.select("key", F.col("row").getField(text_col).alias("text"))).withColumnRenamed("node", "key")
        id_, own = F.col("row").getField(id_col), F.col("row").getField(text_col)
        light = rows.select("key", "uid", id_.alias("id"), F.xxhash64(own).alias("h")).join(roots, "key", "left")
        order = F.struct(F.col("id").isNull().alias("n"), "id", "key", "h", "uid")
        best = light.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(order).alias("m")).select(F.col("m.uid").alias("uid"))
        stay = without(rows, rows.select("uid").join(best, "uid", "left_anti"))
    return stay.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
