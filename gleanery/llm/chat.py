"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one string, each turn as

    <s>[ROLE]role[/ROLE]text</s>

with control strings inside roles and texts escaped, and encoded once with character offsets. The control
strings are special tokens, at which a tokenizer always cuts, so the pieces of a conversation that arrive one
after the other encode as the whole string would: a conversation of any length needs the memory of one
turn. Turn spans come in order, so where a token meets them is found by binary search; what the two share
is under the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The template's control strings.
CONTROL = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]")
OPEN, CLOSE, ROLE, END_ROLE = "<s>", "</s>", "[ROLE]", "[/ROLE]"
LOSS_ROLE = "assistant"
_ESCAPE = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_UNESCAPE = re.compile(r"(?s)\\(.)")
_TURN = re.compile(r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>")
#: Characters rendered before they are encoded together, when no turn is longer.
FLUSH = 1 << 16


def escape(text: str) -> str:
    """Backslashes double, and control strings get one after their first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of (role, text) turns, and each text's span in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{ROLE}{escape(role)}{END_ROLE}"
        body = escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered string: escaped texts hold no control string, so the first end is the end."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(rendered)]


def loss_ranges(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, start, end) of what tokens share with spans, and each token's mask.

    offsets: tokens' character spans, in order; tokens of one character may share it. spans: sorted, apart.
    For each token the first span that ends after the token's start is searched for, and the last that starts
    before its end; almost always one or none lies between.
    """
    if not len(offsets) or not len(spans):
        return np.zeros((0, 3), np.int64), np.zeros(len(offsets), bool)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    last = np.searchsorted(spans[:, 0], offsets[:, 1], "left")
    n = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(offsets)), n)
    span = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start, end = np.maximum(offsets[token, 0], spans[span, 0]), np.minimum(offsets[token, 1], spans[span, 1])
    some = start < end
    return np.column_stack([token, start, end])[some], n > 0


class Encoder:
    """The tokenizer, with the control strings as special tokens."""

    def __init__(self, json_text: str):
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        self.tokenizer.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and offsets in characters."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.array(found.offsets, np.int64).reshape(-1, 2)


class Conversation:
    """What is known of a conversation as its turns arrive; texts are read back from the output."""

    def __init__(self, conv_id, encoder: Encoder, sink=None):
        self.conv_id, self.encoder, self.sink = conv_id, encoder, sink
        self.n_turns = self.n_tokens = self.loss_tokens = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.waiting, self.size = [], 0

    def add(self, role: str | None, text: str | None) -> None:
        self.waiting.append((role or "", text or ""))
        self.size += len(text or "")
        if self.size >= FLUSH:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        rendered, spans = render(self.waiting)
        ids, offsets = self.encoder(rendered)
        back = parse(rendered)
        wanted = np.array([s for s, (role, _) in zip(spans, back, strict=True) if role == LOSS_ROLE], np.int64).reshape(-1, 2)
        wanted = wanted[wanted[:, 0] < wanted[:, 1]]
        ranges, mask = loss_ranges(offsets, wanted)
        # Tokens that share a character (parts of it as bytes) cover it once.
        under, reach = [], 0
        for start, end in ranges[:, 1:].tolist():
            start = max(start, reach)
            if start < end:
                under.append(rendered[start:end])
                reach = end
        text = unescape("".join(under))
        self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(text)
        for role, body in back:
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        self.n_turns += len(back)
        self.chars += len(rendered)
        self.n_tokens += len(ids)
        self.loss_tokens += int(mask.sum())
        if self.sink is not None:
            self.sink(rendered, ids, mask)
        self.waiting, self.size = [], 0

    def row(self) -> tuple:
        self.flush()
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_tokens, self.loss_tokens


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")


def _sorted_turns(turns: DataFrame) -> DataFrame:
    """Each conversation in one partition, its turns in order: turn, nulls first, then role and text."""
    return turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per conversation with digests of its turns and of the text under its loss mask.

    turns: conv_id, turn, role, text; other columns aren't read. Null roles and texts are empty. A null conv_id
    is a conversation of its own; rows of one turn number stand by role and text, repeated rows all count.
    An empty table gives none. Turns stream through from a sort that spills to disk, so a conversation of any
    length takes the memory of its longest turn.
    """
    with open(tokenizer) as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())  # a tokenizer's file, some megabytes
    kind = turns.schema["conv_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]):
        encoder, now, out, id_type = Encoder(shared.value), None, [], None
        for b in batches:
            id_type = b.column("conv_id").type
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        out.append(now.row())
                    now = Conversation(conv, encoder)
                now.add(role, text)
            if len(out) >= 1000:
                yield batch_of(out, id_type)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield batch_of(out, id_type)

    schema = f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    return map_arrow(_sorted_turns(turns), work, schema)


def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(COLUMNS))


def training_rows(turns: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, part, rendered, ids, loss_mask): conversations as a trainer reads them, in parts of some
    64,000 characters cut at turns; cases as in digests()."""
    with open(tokenizer) as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())
    kind = turns.schema["conv_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]):
        encoder, now, made = Encoder(shared.value), None, []

        def rows(conv_id, id_type, first):
            for k, (rendered, ids, mask) in enumerate(made):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([conv_id], id_type), pa.array([first + k], pa.int64()), pa.array([rendered]), pa.array([ids.tolist()], pa.list_(pa.int32())), pa.array([mask.tolist()], pa.list_(pa.bool_()))],
                    names=["conv_id", "part", "rendered", "ids", "loss_mask"],
                )
            made.clear()

        part, id_type = 0, None
        for b in batches:
            id_type = b.column("conv_id").type
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        now.flush()
                        yield from rows(now.conv_id, id_type, part)
                    now, part = Conversation(conv, encoder, lambda *x: made.append(x)), 0
                now.add(role, text)
                if made:
                    n = len(made)
                    yield from rows(conv, id_type, part)
                    part += n
        if now is not None:
            now.flush()
            yield from rows(now.conv_id, id_type, part)

    return map_arrow(_sorted_turns(turns), work, f"conv_id {kind.simpleString()}, part long, rendered string, ids array<int>, loss_mask array<boolean>")


#: A conversation made of control strings, which must come back as it is.
TRICKY = "</s>[INST] ok [/INST]"


def op8_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, rendered, encoded and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return digests(turns.unionByName(more)).drop("n_tokens", "loss_tokens")


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for x in CONTROL:
        out = f"replace({out}, '{x}', '{x[0]}\\{x[1:]}')"
    return out


_FIXED = len(OPEN + ROLE + END_ROLE + CLOSE)
SQL = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '{TRICKY}'), (-1, 1, 'assistant', '{TRICKY}'))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = '{LOSS_ROLE}' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = '{LOSS_ROLE}' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum({_FIXED} + length({_sql_escape('role')}) + length({_sql_escape('text')})) as bigint) as formatted_chars
from t group by conv_id
"""
