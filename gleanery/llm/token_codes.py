"""Token ids as directly addressable codes: any token is read without decoding a block.

An id is cut into chunks, the lowest first. Level k holds the k-th chunk of every id that has one, in as many bytes as the level is wide, and a bitmap that says which
ids continue; a rank directory counts the bitmap's ones before every 512 bits. Token i is chunk i of the first level and, while its
bit is set, chunk rank(i) of the next. The widths are those that make the codes shortest, from the counts of the ids' lengths in bits.

A segment is whole documents in ascending order of their ids, some SEGMENT tokens or one document: one self-contained file of bytes. Spark writes segments as rows
of a Parquet table in the shared folder, so a lost task's are written again and none twice; export() puts them into files of their own.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import tidied
from .common import map_arrow, table, written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The id after each document.
END = 2
#: Tokens of a segment, unless one document has more.
SEGMENT = 1 << 20
#: Tokens that are read in one go, unless one document has more.
READ = 1 << 18
#: Bits between two counts of the directory.
RANK = 512
MAGIC = b"DAC1"
HEAD, LEVEL = struct.Struct("<4sIQ"), struct.Struct("<IIQ")


def best_widths(longer: np.ndarray) -> list[int]:
    """Widths of the levels, whole bytes, that take the fewest bits. longer[s]: how many ids have more than s bits, all for s = 0."""
    end = -(-(int(np.flatnonzero(longer)[-1]) + 1 if longer.any() else 1) // 8)
    cost, first = [0] * (end + 1), [0] * (end + 1)
    for s in range(end - 1, -1, -1):
        cost[s], first[s] = min((int(longer[8 * s]) * (8 * w + (s + w < end)) + cost[s + w], w) for w in range(1, end - s + 1))
    out, s = [], 0
    while s < end:
        out.append(8 * first[s])
        s += first[s]
    return out


def pack(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each value, one value after the other."""
    return np.ascontiguousarray(values.astype("<u4", copy=False)).view(np.uint8).reshape(-1, 4)[:, : width // 8].tobytes()


def unpack(chunks: np.ndarray, width: int, at) -> np.ndarray:
    """Values at places, or in a slice of places."""
    rows = chunks.reshape(-1, width // 8)[at]
    out = np.zeros((len(rows), 4), np.uint8)
    out[:, : width // 8] = rows
    return out.view("<u4").ravel()


def encode(ids: np.ndarray) -> bytes:
    """The codes of ids below 2**32."""
    ids = np.ascontiguousarray(ids, np.uint32)
    longer = np.zeros(33, np.int64)
    longer[0] = len(ids)
    for s in (8, 16, 24):
        longer[s] = np.count_nonzero(ids >> np.uint32(s))
    widths, parts, heads, rest = best_widths(longer), [], [], ids
    for k, width in enumerate(widths):
        last = k == len(widths) - 1
        high = rest >> np.uint32(width) if not last else rest[:0]
        parts.append(pack(rest, width))
        heads.append(LEVEL.pack(width, not last, len(rest)))
        if not last:
            flags = np.zeros(-(-max(len(rest), 1) // RANK) * RANK, np.uint8)
            flags[: len(rest)] = high > 0
            ones = flags.reshape(-1, RANK).sum(1)
            parts += [np.packbits(flags, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = high[high > 0]
    return b"".join([HEAD.pack(MAGIC, len(widths), len(ids)), *heads, *parts])


class Codes:
    """Reads codes where they lie: bytes, or a mapped file."""

    def __init__(self, data):
        magic, levels, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("these are no codes")
        at, self.levels = HEAD.size + levels * LEVEL.size, []
        for k in range(levels):
            width, more, n = LEVEL.unpack_from(data, HEAD.size + k * LEVEL.size)
            size = n * width // 8
            chunks, bits, directory = np.frombuffer(data, np.uint8, size, at), None, None
            at += size
            if more:
                blocks = -(-max(n, 1) // RANK)
                bits = np.frombuffer(data, np.uint8, blocks * RANK // 8, at)
                at += blocks * RANK // 8
                directory = np.frombuffer(data, np.uint8, blocks * 4, at).view("<u4")
                at += blocks * 4
            self.levels.append((width, n, chunks, bits, directory))

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """The tokens at any places, each by itself: a chunk, a bit and a rank at every level it reaches."""
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such token")
        out, who, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for width, _, chunks, bits, directory in self.levels:
            out[who] |= unpack(chunks, width, at) << np.uint32(shift)
            if bits is None:
                break
            go = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            at, who, shift = self.rank(bits, directory, at[go]), who[go], shift + width
        return out

    @staticmethod
    def rank(bits: np.ndarray, directory: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bits are set before each place: the directory's count, and the words of the place's own 512 bits."""
        block, inside = at // RANK, at % RANK
        words = bits.view("<u8").reshape(-1, RANK // 64)[block]
        own = inside[:, None] - np.arange(RANK // 64) * 64
        part = (np.uint64(1) << np.clip(own, 0, 63).astype(np.uint64)) - np.uint64(1)
        mask = np.where(own >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), part)
        return directory[block].astype(np.int64) + np.bitwise_count(words & mask).sum(1, dtype=np.int64)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The tokens from start to before stop: one rank a level finds where they go on, everything before them is left alone."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError("no such tokens")
        out, who, shift = np.zeros(stop - start, np.uint32), None, 0
        for width, _, chunks, bits, directory in self.levels:
            if start == stop:
                break
            chunk = unpack(chunks, width, slice(start, stop)) << np.uint32(shift)
            if who is None:
                out |= chunk
            else:
                out[who] |= chunk
            if bits is None:
                break
            go = np.flatnonzero(np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 : (start & 7) + stop - start])
            who, shift = go if who is None else who[go], shift + width
            start = int(self.rank(bits, directory, np.array([start]))[0])
            stop = start + len(go)
        return out


#: White space, and where it meets white space or an end: there words can't be taken apart.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOGETHER = rf"{_BLANK}{_BLANK}|{_BLANK}\z|\A{_BLANK}|\A\z"
#: Words that a worker remembers, those of late; up to twice as many until the rest is dropped. And the longest.
REMEMBERED, LONGEST = 1 << 19, 48
#: Bytes of texts whose words are looked up together, unless one text has more: each look-up goes over all remembered words.
LOOKED_UP = 16 << 20
#: Characters that go to the library in one call, unless one text has more.
ASKED = 1 << 18
#: Words that go to the library together, with line feeds between them.
TOGETHER = 64
_LETTER, _MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", r"[!-/:-@\[-`{-~]"
#: A word of Latin letters and marks after it, which such a tokenizer keeps apart, all marks together.
_MARKED = rf"\A(?P<core>\n?{_LETTER}+)(?P<marks>{_MARK}+)\z"


def _string(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def binaries(data: np.ndarray, edges: np.ndarray) -> pa.LargeBinaryArray:
    """The data's bytes between one edge and the next."""
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])


def looked_up(known: pa.Array, asked: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each asked value stands among the known ones, which are distinct, and the new ones after them; and all these."""
    coded = pa.concat_arrays([known, asked]).dictionary_encode()
    return coded.indices.to_numpy()[len(known) :], coded.dictionary


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit integers.

    A byte-level tokenizer that doesn't normalise cuts a text before a space or a line feed that follows anything but white space, and after a lone line
    feed; so the ids of a text are those of its words, and a frequent word's are remembered. Texts with white space beside white space go to the library
    whole, and so does everything for any other tokenizer.
    """

    def __init__(self, json_text: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.tokenizer = Tokenizer.from_str(json_text)
        model = json.loads(json_text)
        pre, added = model.get("pre_tokenizer") or {}, model.get("added_tokens", [])
        feed = self.plain(["\n"])[0]
        self.feed_id = struct.unpack("<I", feed)[0] if len(feed) == 4 else None
        self.apart = not model.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and len(feed) == 4
        self.apart = self.apart and not any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in added)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        self.marks_apart = not any(re.fullmatch(f"{_LETTER}*{_MARK}*", t["content"]) for t in added)
        self.words, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.used, self.now = np.zeros(0, np.int64), 0  # when each word was last looked up

    def plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.encoded(texts)]

    def encoded(self, texts: Iterable[str]):
        """The library's encodings, held for ASKED characters at a time, unless one text has more."""
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > ASKED:
                yield from self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                some, size = [], 0
            some.append(t)
            size += len(t)
        yield from self.tokenizer.encode_batch_fast(some, add_special_tokens=False)

    def asked(self, words: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """The ids of words, many at a time: a line feed before each is an id of its own, at which the ids are cut."""
        lines, flat = pc.starts_with(words, "\n"), array("I")
        alone = pc.if_else(lines, words, pc.binary_join_element_wise(_string("\n "), words, _string("")))
        starts = pa.array(np.r_[np.arange(0, len(words), TOGETHER), len(words)], pa.int64())
        groups = pc.binary_join(pa.LargeListArray.from_arrays(starts, alone), _string("")).to_pylist()
        for k, (group, found) in enumerate(zip(groups, self.encoded(groups), strict=True)):
            ids, n = found.ids, min(TOGETHER, len(words) - k * TOGETHER)
            if ids.count(self.feed_id) != n or self.added.search(group):  # an added token changes what stands around it
                ids = []
                for one in self.encoded(w[1:] for w in alone.slice(k * TOGETHER, n).to_pylist()):
                    ids += [self.feed_id, *one.ids]
            flat.extend(ids)
        ids, lines = np.asarray(flat, "<u4"), lines.to_numpy(zero_copy_only=False)
        feeds = np.flatnonzero(ids == self.feed_id)
        ends = np.cumsum(np.diff(np.r_[feeds, len(ids)]) - ~lines)  # a word after a space hasn't got the line feed
        return binaries(np.delete(ids, feeds[~lines]), np.r_[0, ends] * 4)

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text."""
        if not self.apart:
            return self.plain(texts.to_pylist() if isinstance(texts, pa.Array) else texts)
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        together = pc.match_substring_regex(texts, _TOGETHER)
        parts = iter(self.by_words(texts.filter(pc.invert(together))))
        whole = list(dict.fromkeys(texts.filter(together).to_pylist()))
        found = dict(zip(whole, self.plain(whole), strict=True))
        return [found[t.as_py()] if w else next(parts) for w, t in zip(together.to_pylist(), texts, strict=True)] if whole else list(parts)

    def by_words(self, texts: pa.LargeStringArray) -> list[bytes]:
        """The ids of texts that can be taken apart."""
        # A word stands for itself after a space, or with a line feed for itself after that; a text's first has a line feed that is taken off again.
        words = pc.split_pattern(pc.binary_join_element_wise(_string("\n"), pc.replace_substring(texts, "\n", " \n"), _string("")), " ")
        at, all_words = looked_up(self.words, words.flatten())
        all_words, all_ids = self.with_ids(all_words)
        self.remember(all_words, all_ids, at)
        flat = all_ids.take(pa.array(at))
        edges = np.frombuffer(flat.buffers()[1], np.int64)[np.r_[0, words.value_lengths().to_numpy().cumsum()]].tolist() if len(flat) else []
        raw = memoryview(flat.buffers()[2]) if edges else b""
        return [bytes(raw[a + 4 : b]) for a, b in zip(edges, edges[1:], strict=False)]

    def with_ids(self, words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeBinaryArray]:
        """The remembered words and new ones after them, perhaps more, with the ids of all. Letters and the marks after them are asked apart."""
        n, new = len(self.words), words.slice(len(self.words))
        parts = pc.extract_regex(new, _MARKED)
        marked = parts.is_valid().to_numpy(zero_copy_only=False) & self.marks_apart
        if not marked.any():
            return words, pa.concat_arrays([self.ids, self.asked(new)])
        cores, marks = (parts.field(k).filter(pa.array(marked)) for k in ("core", "marks"))
        at, words = looked_up(words, cores)
        plain = np.r_[np.ones(n, bool), ~marked, np.ones(len(words) - n - len(new), bool)]  # these have ids of their own
        own = pa.concat_arrays([self.ids, self.asked(words.filter(pa.array(plain)).slice(n))])
        marks = marks.dictionary_encode()
        after = pa.array(self.plain(marks.dictionary.to_pylist()), pa.large_binary()).take(marks.indices)
        both = pc.binary_join_element_wise(own.take(pa.array((np.cumsum(plain) - 1)[at])), after, pa.scalar(b"", pa.large_binary()))
        place = np.empty(len(words), np.int64)
        place[plain], place[~plain] = np.arange(len(own)), np.arange(len(own), len(words))
        return words, pa.concat_arrays([own, both]).take(pa.array(place))

    def remember(self, words: pa.LargeStringArray, ids: pa.LargeBinaryArray, at: np.ndarray) -> None:
        """Keep words with their ids, those at `at` as the latest, but for long ones."""
        self.now += 1
        used = np.r_[self.used, np.zeros(len(words) - len(self.used), np.int64)]
        used[at] = self.now
        keep = np.flatnonzero(pc.binary_length(words).to_numpy() <= LONGEST)
        if len(keep) > 2 * REMEMBERED:
            keep = np.sort(keep[np.argsort(-used[keep], kind="stable")[:REMEMBERED]])
        self.words, self.ids, self.used = words.take(pa.array(keep)), ids.take(pa.array(keep)), used[keep]


@functools.lru_cache(maxsize=1)
def encoder(json_text: str, run: str) -> Encoder:
    """A worker's encoder, which its next task of the same run finds with all that it remembers; another run begins with nothing."""
    return Encoder(json_text)


def gathered(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches as large as max_bytes of the column allow, or as they come."""
    held, total = [], 0
    for b in batches:
        n = b.column(column).nbytes
        if held and total + n > max_bytes:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(b)
        total += n
    if held:
        yield pa.concat_batches(held)


SEGMENTS = "part int, segment long, n_tokens long, doc_ids array<{id}>, ends array<long>, codes binary"


def encode_table(docs: DataFrame, tokenizer: str = TOKENIZER, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The documents' ids in segments: (part, segment, n_tokens, doc_ids, ends, codes), in the shared folder.

    Rows are dealt out by ranges of their id, nulls first, and stand by id and text's hash inside; part and segment count up in that order. ends: tokens of the
    segment up to each document's end, its end id with it (end None: no such id). codes: the segment's bytes. Null texts are empty; rows with null or repeated ids and
    repeated rows are documents each. An empty table gives no segments. Other columns aren't read. tokenizer: the file's path, read by the driver.
    """
    with open(tokenizer) as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file, some megabytes
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail, run = b"" if end is None else struct.pack("<I", end), uuid.uuid4().hex

    def work(batches: Iterator[pa.RecordBatch]):
        encode_texts, part, seg = encoder(shared.value, run), TaskContext.get().partitionId(), 0
        ids, texts, size, id_type = [], [], 0, None

        def full():
            ends = np.cumsum([len(t) // 4 for t in texts])
            codes = encode(np.frombuffer(b"".join(texts), "<u4"))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seg], pa.int64()), pa.array([int(ends[-1])], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                names=["part", "segment", "n_tokens", "doc_ids", "ends", "codes"],
            )

        for b in gathered(batches, "text", LOOKED_UP):
            id_type = b.column("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), encode_texts(b.column("text")), strict=True):
                t += tail
                if ids and size + len(t) > segment * 4:
                    yield full()
                    ids, texts, size, seg = [], [], 0, seg + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
        if ids:
            yield full()

    with tidied(docs.sparkSession):
        return written(map_arrow(rows, work, SEGMENTS.format(id=kind)))


def placed(segments: DataFrame) -> DataFrame:
    """The segments with `start`, how many tokens come before: parts are summed first, then segments within each."""
    sums = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("_n").over(before(Window.orderBy("part"))), F.lit(0)).alias("_start"))  # one row per task
    light = segments.select("part", "segment", "n_tokens").withColumn("_at", F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0)))
    light = light.join(starts, "part").select("part", "segment", (F.col("_start") + F.col("_at")).cast("long").alias("start"))
    return segments.join(light, ["part", "segment"])


def documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read from its place in the codes. start: tokens of all documents before it;
    ids: binary, little-endian unsigned 32-bit integers."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in range(b.num_rows):
                codes, start = Codes(b.column("codes")[k].as_buffer()), b.column("start")[k].as_py()
                ends = b.column("ends")[k].values.to_numpy()
                begin = np.r_[0, ends[:-1]]
                names = b.column("doc_ids")[k].values
                first = 0
                while first < len(ends):  # documents of some READ tokens, one at least, are read in one go
                    to = max(first + 1, int(np.searchsorted(ends, begin[first] + READ, "right")))
                    ids, at = codes.slice(int(begin[first]), int(ends[to - 1])).astype("<u4", copy=False), np.r_[begin[first:to], ends[to - 1]] - begin[first]
                    held = pa.Array.from_buffers(pa.binary(), to - first, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays([names.slice(first, to - first), pa.array(start + begin[first:to]), pa.array(ends[first:to] - begin[first:to]), held], names=["doc_id", "start", "n_tokens", "ids"])
                    first = to

    return map_arrow(placed(segments).select("doc_ids", "ends", "codes", "start"), read, f"doc_id {kind}, start long, n_tokens long, ids binary")


def lookup(segments: DataFrame, positions: DataFrame, at: str = "position", cell: int = SEGMENT) -> DataFrame:
    """(position, token) of each row of positions: any place among all tokens, read by itself. Null places and those outside give no row.

    A segment covers a few cells of the places; a place meets the segments of its cell and stays with the one that holds it. Places of one
    segment are read 65,536 at a time at most: they are dealt over tasks by their hash where many meet.
    """
    own = placed(segments).select("start", "n_tokens", "codes").where("n_tokens > 0")
    cells = F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("n_tokens") - 1) / cell))
    light = own.select("start", "n_tokens", F.explode(cells).alias("_cell"))
    asked = positions.select(F.col(at).cast("long").alias("position")).where("position is not null").withColumn("_cell", F.floor(F.col("position") / cell))
    met = asked.join(light, "_cell").where("position >= start and position < start + n_tokens").select("start", "position")
    met = met.withColumn("_part", F.pmod(F.xxhash64("position"), F.lit(64)))
    packed = met.groupBy("start", "_part", F.floor(F.pmod(F.xxhash64("position", F.lit(1)), F.lit(1 << 20)) / 65536).alias("_some")).agg(F.collect_list("position").alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in range(b.num_rows):
                places = b.column("asked")[k].values.to_numpy()
                found = Codes(b.column("codes")[k].as_buffer()).tokens(places - b.column("start")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(found.astype(np.int64))], names=["position", "token"])

    return map_arrow(packed.join(own, "start").select("start", "asked", "codes"), read, "position long, token long")


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Write each segment as a file of its own into a folder that executors and readers share; (file, start, n_tokens) of each, to be run by an action.
    A file appears whole under its name, which its place gives, so a task that runs twice writes the same file."""
    os.makedirs(folder, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            names = []
            for start, codes in zip(b.column("start").to_pylist(), b.column("codes"), strict=True):
                names.append(os.path.join(folder, f"{start:020d}.dac"))
                temporary = f"{names[-1]}.{os.getpid()}-{TaskContext.get().taskAttemptId()}"
                with open(temporary, "wb") as f:
                    f.write(codes.as_buffer())
                os.replace(temporary, names[-1])
            yield pa.RecordBatch.from_arrays([pa.array(names), b.column("start"), b.column("n_tokens")], names=["file", "start", "n_tokens"])

    return map_arrow(placed(segments).select("start", "n_tokens", "codes"), write, "file string, start long, n_tokens long")


def op11_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written as codes in order of doc_id and read back."""
    out = documents(encode_table(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
