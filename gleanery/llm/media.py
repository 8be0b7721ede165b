"""Media columns: payloads in content-defined chunks, each kept once.

A rolling gear hash cuts a payload where its content says so, so payloads that share passages share chunks. The
digests of all chunks meet in a Spark join that gives each chunk one owner; a payload's stored form is
the ordered list of its chunks with the bytes of those it owns. Reading back fetches the others from their
owners by a join on digests, checks every chunk against its digest and puts the payload together again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, written

UNIT = 576
#: Chunk sizes: 2**BITS more than the least, on average.
LEAST, MOST, BITS = 1024, 16384, 11
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)
MAGIC = b"CHNK"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 and its length; bytes 255 fill it up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT), len(data)


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks. The hash at a byte sums its and the 31 bytes' before it, each shifted by its age:
    five doublings of the window give it everywhere. A chunk ends where the top bits are 0, but not before
    `least` bytes, and at `most` bytes in any case."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    found = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, start, n = [], 0, len(data)
    while n - start > least:
        at = np.searchsorted(found, start + least)
        end = min(int(found[at]) if at < len(found) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def digest(chunk: bytes) -> bytes:
    """128 bits of SHA-256."""
    return hashlib.sha256(chunk).digest()[:16]


def container(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """A media file: the ordered chunk list with lengths and digests, then the chunks."""
    head = MAGIC + struct.pack(">I", len(chunks)) + b"".join(struct.pack(">I", len(c)) + d for c, d in zip(chunks, digests, strict=True))
    return head + b"".join(chunks)


def open_container(media: bytes) -> bytes:
    """The payload of a media file; every chunk is held against its digest."""
    if media[:4] != MAGIC:
        raise ValueError("not a chunked media file")
    (n,) = struct.unpack(">I", media[4:8])
    at, out = 8 + 20 * n, []
    for i in range(n):
        size, want = struct.unpack(">I", media[8 + 20 * i : 12 + 20 * i])[0], media[12 + 20 * i : 28 + 20 * i]
        chunk = media[at : at + size]
        if digest(chunk) != want:
            raise ValueError("a chunk doesn't match its digest")
        out.append(chunk)
        at += size
    return b"".join(out)


def feature(payload: bytes, chunks: int) -> str:
    """Chunks, and the mean, deviation and entropy of the samples."""
    n = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = n / n.sum()
    mean = float(p @ np.arange(256))
    deviation = float(np.sqrt(p @ (np.arange(256) - mean) ** 2))
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    return f"chunks={chunks};mean={mean:.3f};deviation={deviation:.3f};entropy={entropy:.4f}"


CHUNK = "struct<at: int, n: int, d: binary, own: boolean, shared: boolean>"
CHUNK_TYPE = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("d", pa.binary()), ("own", pa.bool_()), ("shared", pa.bool_())])


def manifest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, n_bytes, chunks) of every row. key: the payload's digest."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "text"):
            keys, sizes, lists = [], [], []
            for text in b.column("text").to_pylist():
                data, n = payload_of(text)
                ends = cuts(data)
                keys.append(digest(data))
                sizes.append(n)
                lists.append([{"n": e - s, "d": digest(data[s:e])} for s, e in zip([0, *ends], ends, strict=False)])
            kind = pa.list_(pa.struct([("n", pa.int32()), ("d", pa.binary())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, kind)], names=["doc_id", "key", "n_bytes", "chunks"])

    return map_arrow(rows, cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key binary, n_bytes long, chunks array<struct<n: int, d: binary>>")


#: A chunk is common if its uses are more than one in this many of all, and HOT at least; so at most COMMON chunks are.
COMMON, HOT, SALTS = 10_000, 10_000, 32


def common_chunks(uses: DataFrame) -> list[bytes]:
    """Digests of chunks that many payloads use: COMMON of them at most."""
    n = uses.count()
    return [bytes(r[0]) for r in uses.groupBy("d").count().where(F.col("count") > max(HOT, n // COMMON)).select("d").collect()]


def chunk_join(uses: DataFrame, owners: DataFrame, common: list[bytes]) -> DataFrame:
    """uses (key, d, ...) joined to one row for each digest d. Uses of common chunks are dealt out over SALTS parts."""
    if not common:
        return uses.join(owners, "d")
    known = F.broadcast(uses.sparkSession.createDataFrame([(bytearray(d), True) for d in common], "d binary, _common boolean"))  # COMMON rows at most
    part = F.when(F.col("_common"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int")
    every = F.when(F.col("_common"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = uses.join(known, "d", "left").withColumn("_part", part).drop("_common")
    right = owners.join(known, "d", "left").withColumn("_part", F.explode(every)).drop("_common")
    return left.join(right, ["d", "_part"]).drop("_part")


def store(docs: DataFrame, listed: DataFrame, text_col: str, common: list[bytes] | None = None) -> DataFrame:
    """A written table (key, recipe, blob, complete): each payload once, with the bytes of the chunks it owns."""
    payloads = listed.groupBy("key").agg(F.first("chunks").alias("chunks"))
    uses = payloads.select("key", F.posexplode("chunks").alias("at", "c")).select("key", "at", "c.n", "c.d")
    owners = uses.groupBy("d").agg(F.min(F.struct("key", "at")).alias("o"), F.count("*").alias("uses"))
    owners = owners.select("d", F.col("o.key").alias("_key"), F.col("o.at").alias("_at"), (F.col("uses") > 1).alias("shared"))
    flagged = chunk_join(uses, owners, common or [])
    own = (F.col("key") == F.col("_key")) & (F.col("at") == F.col("_at"))
    recipes = flagged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "d", own.alias("own"), "shared"))).alias("recipe"))

    # Squeezed for the way; the dictionary is the starts of some texts, 384 kB at most. It bears on sizes alone.
    starts = docs.select(F.substring(text_col, 1, 4096)).limit(200).collect()
    some = "".join(r[0] or "" for r in starts).encode("utf-8", "surrogatepass")[: 384 << 10]
    words = docs.sparkSession.sparkContext.broadcast(some)

    def tools():
        dictionary = zstandard.ZstdCompressionDict(words.value, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(words.value) > 8 else None
        return zstandard.ZstdCompressor(level=9, dict_data=dictionary, write_checksum=False), zstandard.ZstdDecompressor(dict_data=dictionary)

    def squeeze(batches: Iterator[pa.RecordBatch]):
        pack, seen = tools()[0], set()
        for b in slices(batches, text_col):
            keys, packed = [], []
            for text in b.column(text_col).to_pylist():
                data, _ = payload_of(text)
                k = digest(data)
                if k not in seen:  # once from each task is enough
                    seen.add(k)
                    keys.append(k)
                    packed.append(pack.compress(data))
                if len(seen) > 500_000:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["key", "z"])

    packed = map_arrow(docs.select(text_col), squeeze, "key binary, z binary")
    both = packed.withColumn("recipe", F.lit(None).cast(f"array<{CHUNK}>")).unionByName(recipes.withColumn("z", F.lit(None).cast("binary")))
    both = both.repartition("key").sortWithinPartitions("key", F.col("recipe").isNull())

    def keep(batches: Iterator[pa.RecordBatch]):
        unpack, recipe, key = tools()[1], None, None
        for b in slices(batches, "z", 1 << 20):
            keys, recipes, blobs, complete = [], [], [], []
            for k, z, r in zip(*(b.column(c).to_pylist() for c in ("key", "z", "recipe")), strict=True):
                if r is not None:
                    key, recipe = k, r
                elif k == key and recipe is not None:  # the first payload after its list; others are the same
                    data, at, parts = unpack.decompress(z), 0, []
                    for c in recipe:
                        if c["own"]:
                            parts.append(data[at : at + c["n"]])
                        at += c["n"]
                    keys.append(k)
                    recipes.append(recipe)
                    blobs.append(b"".join(parts))
                    complete.append(len(parts) == len(recipe))
                    recipe = None
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(recipes, pa.list_(CHUNK_TYPE)), pa.array(blobs, pa.binary()), pa.array(complete, pa.bool_())], names=["key", "recipe", "blob", "complete"])

    return written(map_arrow(both, keep, f"key binary, recipe array<{CHUNK}>, blob binary, complete boolean"), level=9, partition_by="complete")


FEATURES = "key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _assembled(rows: list[tuple[bytes, list, list[bytes]]]):
    """(key, container, payload read out of it, number of chunks) of each payload, held against its key."""
    for key, recipe, chunks in rows:
        media = container(chunks, [c["d"] for c in recipe])
        data = open_container(media)
        if digest(data) != key:
            raise ValueError("a payload doesn't match its key")
        yield key, media, data, len(chunks)


def _described(rows: list[tuple[bytes, list, list[bytes]]]) -> pa.RecordBatch:
    out = [
        (key, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(data, n))
        for key, media, data, n in _assembled(rows)
    ]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["key", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    columns = list(zip(*out, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


PAYLOADS = "key binary, payload binary, media binary"


def _bytes(rows: list[tuple[bytes, list, list[bytes]]]) -> pa.RecordBatch:
    out = [(key, data, media) for key, media, data, _ in _assembled(rows)]
    columns = list(zip(*out, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["key", "payload", "media"])


def _own_chunks(recipe: list[dict], blob: bytes) -> dict[int, bytes]:
    out, at = {}, 0
    for c in recipe:
        if c["own"]:
            out[c["at"]] = blob[at : at + c["n"]]
            at += c["n"]
    return out


def read_back(kept: DataFrame, common: list[bytes] | None = None, give=_described, schema: str = FEATURES) -> DataFrame:
    """FEATURES of every payload in a store, from its stored chunks; or what else give makes of (key, recipe, chunks) rows, in that schema."""

    def alone(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "blob", 1 << 20):
            rows = []
            for key, recipe, blob in zip(*(b.column(c).to_pylist() for c in ("key", "recipe", "blob")), strict=True):
                own = _own_chunks(recipe, blob)
                rows.append((key, recipe, [own[c["at"]] for c in recipe]))
            yield give(rows)

    def shared(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, "blob", 1 << 20):
            digests, chunks = [], []
            for recipe, blob in zip(*(b.column(c).to_pylist() for c in ("recipe", "blob")), strict=True):
                own = _own_chunks(recipe, blob)
                for c in recipe:
                    if c["own"] and c["shared"]:
                        digests.append(c["d"])
                        chunks.append(own[c["at"]])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], names=["d", "chunk"])

    whole = map_arrow(kept.where("complete").select("key", "recipe", "blob"), alone, schema)
    part = kept.where("not complete").select("key", "recipe", "blob")
    lent = kept.where(F.exists("recipe", lambda c: c["own"] & c["shared"])).select("recipe", "blob")
    lent = map_arrow(lent, shared, "d binary, chunk binary")
    wanted = part.select("key", F.explode(F.filter("recipe", lambda c: ~c["own"])).alias("c")).select("key", "c.at", "c.d")
    fetched = chunk_join(wanted, lent, common or []).select("key", "at", "chunk")
    none = lambda kind: F.lit(None).cast(kind)
    both = part.select("key", F.lit(-1).alias("at"), "recipe", "blob").unionByName(
        fetched.select("key", "at", none(f"array<{CHUNK}>").alias("recipe"), F.col("chunk").alias("blob"))
    )
    both = both.repartition("key").sortWithinPartitions("key", "at")

    def put_together(batches: Iterator[pa.RecordBatch]):
        key, recipe, have = None, None, {}

        def done():
            return (key, recipe, [have[c["at"]] for c in recipe])

        for b in slices(batches, "blob", 1 << 20):
            rows = []
            for k, at, r, blob in zip(*(b.column(c).to_pylist() for c in ("key", "at", "recipe", "blob")), strict=True):
                if at == -1:
                    if recipe is not None:
                        rows.append(done())
                    key, recipe, have = k, r, _own_chunks(r, blob)
                else:
                    have[at] = blob
            if rows:
                yield give(rows)
        if recipe is not None:
            yield give([done()])

    return whole.unionByName(map_arrow(both, put_together, schema))


def payloads(kept: DataFrame, common: list[bytes] | None = None) -> DataFrame:
    """(key, payload, media) of every payload in a store: its bytes, put together from the stored chunks and verified, and the container they are exported in.

    A payload is in one row, whatever the number of documents that share it; manifest() says which (key, n_bytes). A missing or damaged chunk raises
    an error. A store without rows gives none.
    """
    return read_back(kept, common, _bytes, PAYLOADS)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every row.

    Null and empty texts: one unit of bytes 255. Rows of equal texts share one stored payload, whatever their ids,
    and get equal values; null and repeated ids are kept. A missing or damaged chunk raises an error. Other columns
    aren't read. Tables without rows give none.
    """
    listed = written(manifest(docs, id_col, text_col))
    common = common_chunks(listed.dropDuplicates(["key"]).select(F.explode("chunks").alias("c")).select("c.d"))
    found = read_back(store(docs, listed, text_col, common), common)
    out = listed.select("doc_id", "key", "n_bytes").join(found, "key")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored payload, read back."""
    return media_column(table(spark, sf_dir, "documents"))
