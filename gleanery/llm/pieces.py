"""SentencePiece encoding and decoding with N-best segmentations.

A text's segmentations are the paths of its piece lattice. Forward Viterbi scores every position by its best
path from the start; a backward A-star search from the end then has an exact heuristic, so it takes up
segmentations best first. Pieces don't cross word starts, so the lattice falls apart there into units:
units are memoised, and the N best of a text deviate from the best only in the N - 1 units whose
runner-up costs least.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import string
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slices, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Scores are integers, parts of a nat, so that ties are exact.
SCALE = 1_000_000
#: The mark for a space in a model's file; here pieces have spaces themselves.
MARK, SPACE = "▁", " "
#: Units that a worker remembers, in each of two generations: used ones move to the young one, and when that is full the old
#: one is forgotten.
MEMO = 450_000


class Pieces:
    """A piece model. Scores of a unigram model are its own; those of a BPE model are merge ranks, so a piece of rank r
    gets the Zipf estimate 1 / (r + 1), normalised. A character without a piece is spelt in byte pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) and s <= 0 for s in score.values()):
            total = math.log(sum(1 / (1 - s) for s in score.values()))
            score = {i: -math.log(1 - s) - total for i, s in score.items()}
        self.score = {sp.id_to_piece(i).replace(MARK, SPACE): (round(s * SCALE), i) for i, s in score.items()}
        self.bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_score = min(s for s, _ in self.score.values()) - 10 * SCALE
        self.text = [b""] * n
        for p, (_, i) in self.score.items():
            self.text[i] = p.encode()
        for b, i in self.bytes_.items():
            self.text[i] = bytes([b])
        #: A tree of characters; a node is [what may follow, score or None, id].
        self.tree: dict[str, list] = {}
        for p, (w, i) in self.score.items():
            level, node = self.tree, None
            for c in p:
                node = level.setdefault(c, [{}, None, -1])
                level = node[0]
            node[1:] = w, i
        self.unit = self.finer = re.compile(r"(?s).+")
        self.odd = None
        if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.score))
            # No piece has a sign after a letter, but for odd letters; texts without those also fall apart there.
            signs = re.escape("".join(c for c in string.punctuation))
            odd = {x for p in self.score for x, c in zip(p, p[1:], strict=False) if c in string.punctuation and x not in string.punctuation and x != SPACE}
            ends = f"|[{alone}]" if alone else ""
            self.unit = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+{ends}")
            self.finer = re.compile(f"{SPACE}+[{signs}]*[^{SPACE}{alone}{signs}]*|[{signs}]+[^{SPACE}{alone}{signs}]*|[^{SPACE}{alone}{signs}]+{ends}")
            self.odd = re.compile(f"[{re.escape(''.join(sorted(odd)))}]") if odd else None
        self.memo: dict[str, tuple[bytes, int, int]] = {}
        self.old: dict[str, tuple[bytes, int, int]] = {}
        self.options: dict[tuple[str, int], list] = {}

    def edges(self, s: str, i: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """(end, score, ids) of what may stand at i. A character without a piece is spelt in bytes."""
        out, level = [], self.tree
        for j in range(i, len(s)):
            node = level.get(s[j])
            if node is None:
                break
            level, w, k = node
            if w is not None:
                out.append((j + 1, w, (k,)))
        if not out or out[0][0] != i + 1:
            spelt = tuple(self.bytes_[b] for b in s[i].encode("utf-8", "surrogatepass"))
            out.append((i + 1, self.byte_score * len(spelt), spelt))
        return out

    def best(self, s: str) -> tuple[bytes, int, int]:
        """Ids (32-bit) and score of a unit's best segmentation, and how much less the runner-up scores (-1: there is none).
        Of equal ones, the last piece is the shortest."""
        n, low, tree = len(s), -(1 << 62), self.tree
        first, second, back = [0] + [low] * n, [low] * (n + 1), [None] * (n + 1)
        for i in range(n):
            a, b, level, j = first[i], second[i], tree, i
            alone = False
            while j < n:
                node = level.get(s[j])
                if node is None:
                    break
                j += 1
                level, w, k = node
                if w is None:
                    continue
                if j == i + 1:
                    alone = True
                x = a + w
                if x >= first[j]:
                    y = b + w
                    second[j] = first[j] if first[j] > y else y
                    first[j] = x
                    back[j] = (i, k)
                elif x > second[j]:
                    second[j] = x
            if not alone:
                j, w, ids = self.edges(s, i)[-1]
                x = a + w
                if x >= first[j]:
                    second[j] = max(first[j], b + w)
                    first[j] = x
                    back[j] = (i, ids)
                elif x > second[j]:
                    second[j] = x
        parts, j = [], n
        while j:
            j, ids = back[j]
            if ids.__class__ is int:
                parts.append(ids)
            else:
                parts.extend(reversed(ids))
        parts.reverse()
        return np.array(parts, "<i4").tobytes(), first[n], first[n] - second[n] if second[n] > low // 2 else -1

    def n_best(self, s: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """A unit's n best (score, ids), best first, by backward A-star over its lattice."""
        ahead: list[list] = [[] for _ in range(len(s) + 1)]
        first = [0] + [None] * len(s)
        for i in range(len(s)):
            for j, w, ids in self.edges(s, i):
                ahead[j].append((i, w, ids))
                if first[j] is None or first[i] + w > first[j]:
                    first[j] = first[i] + w
        # Of equal totals the one nearest the start goes first, so ties don't widen the search.
        tick, out = count(), []
        agenda = [(-first[-1], len(s), 0, 0, None)]
        while agenda and len(out) < n:
            _, j, _, done, tail = heapq.heappop(agenda)
            if j == 0:
                ids = []
                while tail:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((done, tuple(ids)))
                continue
            for i, w, ids in ahead[j]:
                heapq.heappush(agenda, (-(done + w + first[i]), i, next(tick), done + w, (ids, tail)))
        return out

    def units(self, text: str) -> list[str]:
        """The text's units, a space before it."""
        pattern = self.unit if self.odd and self.odd.search(text) else self.finer
        return pattern.findall(SPACE + text)

    def encode(self, text: str | None, n: int = N_BEST) -> list[tuple[float, np.ndarray]]:
        """Up to n (log score, ids), best first; of equal ones, those that deviate earlier. Empty or null: one, without ids."""
        if not text:
            return [(0.0, np.zeros(0, np.int32))]
        units = self.units(text)
        found = list(map(self.memo.get, units))
        if None in found:
            self.remember(units, found)
        ids = np.frombuffer(b"".join([x[0] for x in found]), "<i4")
        total = sum([x[1] for x in found])
        out = [(total / SCALE, ids)]
        if n > 1:
            gap = np.array([x[2] for x in found])
            some = np.flatnonzero(gap >= 0)
            if len(some) > n - 1:
                most = np.partition(gap[some], n - 2)[n - 2]
                less = some[gap[some] < most]
                some = np.sort(np.r_[less, some[gap[some] == most][: n - 1 - len(less)]])
            if len(some):
                starts = np.cumsum([0] + [len(x[0]) for x in found]) // 4
                out += self._combine([(int(k), self.ways(units[k], n)) for k in some], total, ids, starts, n)
        return out

    def remember(self, units: list[str], found: list) -> None:
        """Fill in what the memo doesn't have."""
        memo, old = self.memo, self.old
        for k, x in enumerate(found):
            if x is None:
                u = units[k]
                x = memo.get(u) or old.get(u) or self.best(u)
                memo[u] = found[k] = x
        if len(memo) > MEMO:
            self.old, self.memo = memo, {}

    def ways(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """n_best(), remembered for short units; each way is held against the unit's text."""
        out = self.options.get((unit, n))
        if out is None:
            out = self.n_best(unit, n)
            want = unit.encode("utf-8", "surrogatepass")
            if any(b"".join([self.text[i] for i in ids]) != want for _, ids in out):
                raise ValueError("a segmentation doesn't decode to its text")
            if len(self.options) > 20_000:
                self.options.clear()
            if len(unit) < 64:
                self.options[(unit, n)] = out
        return out

    def _combine(self, lists, total: int, ids: np.ndarray, starts, n: int) -> list[tuple[float, np.ndarray]]:
        """The 2nd to nth best choices of one option from each list; the rest of the text stays."""
        loss = [[options[0][0] - s for s, _ in options] for _, options in lists]
        agenda, seen, out = [(0, tuple([0] * len(lists)))], {tuple([0] * len(lists))}, []
        while agenda and len(out) < n:
            lost, at = heapq.heappop(agenda)
            out.append((lost, at))
            for k in range(len(lists)):
                if at[k] + 1 < len(loss[k]):
                    new = (*at[:k], at[k] + 1, *at[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        heapq.heappush(agenda, (lost - loss[k][at[k]] + loss[k][at[k] + 1], new))
        made = []
        for lost, at in out[1:]:
            parts, done = [], 0
            for k, choice in enumerate(at):
                unit, options = lists[k]
                if choice:
                    parts += [ids[done : starts[unit]], np.array(options[choice][1], np.int32)]
                    done = starts[unit + 1]
            made.append(((total - lost) / SCALE, np.concatenate([*parts, ids[done:]])))
        return made

    def decode(self, ids) -> str:
        """The text of ids, without the space before it."""
        out = b"".join(map(self.text.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_MODELS: dict[bytes, Pieces] = {}


def loaded(proto: bytes) -> Pieces:
    """The model, and its memo, of this worker; one at a time."""
    if proto not in _MODELS:
        _MODELS.clear()
        _MODELS[proto] = Pieces(proto)
        gc.set_threshold(200_000, 20, 100)  # a large memo of small tuples, none in cycles
    return _MODELS[proto]


SCHEMA = (
    "doc_id {}, n_pieces long, ids array<int>, decoded boolean,"
    " n_best array<struct<score: double, n_pieces: long, ids_crc32: long>>"
)


def encode_table(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids, decoded, n_best) of every row: the best segmentation of the whole text, whether it decodes to the
    text, and score, pieces and CRC-32 (of 32-bit little-endian ids) of the n best. The others' deviations are decoded too.

    Other columns aren't read. Null and empty texts: no ids, one segmentation of score 0. Rows with null or
    repeated ids are encoded each by itself; of equal scores the one that deviates earlier in the text comes last
    changed. Tables without rows give none. The model's bytes go to the executors, its path is read by the driver.
    """
    with open(model, "rb") as f:
        proto = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(proto)  # a model file, half a megabyte
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]):
        pieces = loaded(shared.value)
        for b in slices(batches, "text", 1 << 20):
            ids, flat, best, right = [], [0], [], []
            for text in b.column("text").to_pylist():
                found = pieces.encode(text, n)
                ids.append(found[0][1])
                flat.append(flat[-1] + len(found[0][1]))
                best.append([{"score": s, "n_pieces": len(i), "ids_crc32": zlib.crc32(i.tobytes())} for s, i in found])
                right.append(pieces.decode(found[0][1]) == (text or ""))
            column = pa.ListArray.from_arrays(pa.array(flat, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
            lengths = pa.array(np.diff(flat))
            kind = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), lengths, column, pa.array(right), pa.array(best, kind)], names=["doc_id", "n_pieces", "ids", "decoded", "n_best"]
            )

    return map_arrow(rows, encode, SCHEMA.format(rows.schema["doc_id"].dataType.simpleString()))


def n_best_table(docs: DataFrame, model: str = MODEL, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rank, score, ids): the n best segmentations of every row's whole text, best first, rank from 1.

    A text that can be cut in fewer ways has fewer rows; null and empty texts have one without ids. Of equal scores the one that deviates earlier in the
    text comes last changed. Rows with null or repeated ids are encoded each by itself. Tables without rows give none. Other columns aren't read.
    """
    with open(model, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # a model file, half a megabyte
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))

    def encode(batches: Iterator[pa.RecordBatch]):
        pieces = loaded(shared.value)
        for b in slices(batches, "_text", 1 << 20):
            origin, ranks, scores, ids = [], [], [], []
            for i, text in enumerate(b.column("_text").to_pylist()):
                for rank, (score, found) in enumerate(pieces.encode(text, n), 1):
                    origin.append(i)
                    ranks.append(rank)
                    scores.append(score)
                    ids.append(found)
            flat = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)
            columns = [b.column(0).take(pa.array(origin, pa.int64())), pa.array(ranks, pa.int32()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(flat), pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "rank", "score", "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_arrow(rows, encode, f"`{id_col}` {kind}, rank int, score double, ids array<int>")


def decode_table(rows: DataFrame, model: str = MODEL, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """rows with one more column, the text of their ids; a column of that name is replaced.

    Null ids give a null text, none an empty one; a null or unknown id fails the job with its number. Bytes that aren't UTF-8 are replaced by U+FFFD.
    Ids of any segmentation of a text give that text, but for spaces that the model adds or maps.
    """
    with open(model, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())  # a model file, half a megabyte
    rows = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c != name))
    at = rows.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]):
        pieces = loaded(shared.value)
        known = len(pieces.text)
        for b in batches:
            texts = []
            for ids in b.column(at).to_pylist():
                wrong = [i for i in ids or () if i is None or not 0 <= i < known]
                if wrong:
                    raise ValueError(f"no piece has the id {wrong[0]}")
                texts.append(None if ids is None else pieces.decode(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    return map_arrow(rows, decode, T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())]))


def op9_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and its four best segmentations."""
    return encode_table(table(spark, sf_dir, "documents"))
