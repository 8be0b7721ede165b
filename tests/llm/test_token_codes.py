"""Directly addressable codes against plain lists, words against whole texts, segments against brute force."""

import glob
import os
import random
import tempfile
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gleanery.llm import queries, token_codes
from gleanery.llm.token_codes import TOKENIZER, Codes, Encoder, best_widths, encode


@pytest.mark.parametrize("n", [0, 1, 5, 511, 512, 513, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 1 << 32])
def test_every_token_and_every_run(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[: n // 2] //= 97
    c = Codes(encode(ids))
    assert c.n == n and (c.slice(0, n) == ids).all() and (c.tokens(np.arange(n)) == ids).all()
    at = rng.integers(0, max(n, 1), 50) if n else np.zeros(0, int)
    assert (c.tokens(at) == ids[at]).all()
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert (c.slice(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        c.tokens(np.array([n]))
    with pytest.raises(IndexError):
        c.slice(0, n + 1)


def test_widths_take_the_fewest_bits():
    """Whole bytes: all ways to cut one to four of them."""
    rng = np.random.default_rng(1)
    for end in range(1, 5):
        for _ in range(20):
            longer = np.zeros(33, int)
            longer[[8 * i for i in range(end)]] = np.sort((10 ** rng.uniform(0, 4, end)).astype(int))[::-1]
            cost = {}
            for cuts in range(1 << (end - 1)):
                edges = [0, *(i for i in range(1, end) if cuts >> (i - 1) & 1), end]
                cost[tuple(8 * (b - a) for a, b in zip(edges, edges[1:], strict=False))] = sum(longer[8 * a] * (8 * (b - a) + (b < end)) for a, b in zip(edges, edges[1:], strict=False))
            got = tuple(best_widths(longer))
            assert cost[got] == min(cost.values())


def test_other_bytes_are_refused():
    with pytest.raises(ValueError, match="no codes"):
        Codes(b"x" * 64)


def test_words_encode_as_their_text():
    e, rng = Encoder(open(TOKENIZER).read()), random.Random(1)
    assert e.apart
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", "é", "'s", "'ll", "1", "23", ".", ",", "日", "😀", "<|endoftext|>", "-", "​", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    lone = [b for b in bits if b.strip()]
    texts += [rng.choice(["", "\n"]).join("".join(rng.choice(lone) for _ in range(rng.randint(1, 4))) + rng.choice([" ", "\n", "\t"]) for _ in range(12)) + "x" for _ in range(3000)]
    assert e(texts) == e.plain(texts)
    other = Encoder(open("/opt/tokenizers/word_bpe_49k.json").read())
    assert not other.apart and other(texts[:50]) == other.plain(texts[:50])


def by_hand(rows, end=2):
    """{(doc_id, start): ids} in order of the id, nulls first; equal ids in any order."""
    t = Tokenizer.from_file(TOKENIZER)
    return [(r[0], [*t.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_odd_rows(spark, odd, odd_rows, none):
    segments = token_codes.encode_table(odd, segment=500)
    assert segments.count() > 4
    got = sorted(token_codes.documents(segments).collect(), key=lambda r: r.start)
    want = by_hand(odd_rows)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted(repr((r.doc_id, np.frombuffer(r.ids, "<u4").tolist())) for r in got) == sorted(repr((i, ids)) for i, ids in want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert token_codes.documents(token_codes.encode_table(none)).collect() == []
    bare = token_codes.documents(token_codes.encode_table(odd, end=None)).agg(F.sum("n_tokens")).first()[0]
    assert bare == sum(len(ids) - 1 for _, ids in want)


def test_any_place_is_read_by_itself(spark, odd, tmp_path):
    segments = token_codes.encode_table(odd, segment=500)
    all_ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in sorted(token_codes.documents(segments).collect(), key=lambda r: r.start)])
    rng = random.Random(3)
    at = [rng.randrange(len(all_ids)) for _ in range(300)] + [0, 0, len(all_ids) - 1]
    asked = spark.createDataFrame([(p,) for p in [*at, None, -1, len(all_ids)]], "position long")
    for cell in (token_codes.SEGMENT, 64):
        got = sorted(map(tuple, token_codes.lookup(segments, asked, cell=cell).collect()))
        assert got == sorted((p, int(all_ids[p])) for p in at)
    files = token_codes.export(segments, str(tmp_path)).collect()
    for f in files:
        with open(f.file, "rb") as h:
            assert (Codes(h.read()).slice(0, f.n_tokens) == all_ids[f.start : f.start + f.n_tokens]).all()
    assert sorted(os.listdir(tmp_path)) == sorted(os.path.basename(f.file) for f in files)


def test_query_equals_plain_encoding(spark, data, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    want, start = {}, 0
    for i, ids in by_hand(rows):
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op11_addressable_codes"](spark, data).collect()}
    assert got == want


def test_documents_are_read_in_ranges(spark, odd, odd_rows, monkeypatch):
    """Ranges of one document, of a few and of all of a segment give the same ids."""
    segments, found = token_codes.encode_table(odd, segment=500), []
    for read in (1, 7, 1 << 18):
        monkeypatch.setattr(token_codes, "READ", read)
        found.append(sorted((r.start, r.n_tokens, repr(r.doc_id), bytes(r.ids)) for r in token_codes.documents(segments).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(odd_rows)
    assert all(len(ids) == 4 * n for _, n, _, ids in found[0])


class Counted:
    """A tokenizer that notes what it is asked."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **k):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **k)


def test_the_library_is_asked_once_for_a_word():
    """Marks in a row stand apart from their word, and the next task of a worker finds tokenizer and words, but another run doesn't."""
    text = open(TOKENIZER).read()
    e = token_codes.encoder(text, "a")
    assert token_codes.encoder("".join(list(text)), "a") is e
    texts = ["Zorblat quimfex\nZorblat", "quimfex,### zorblat!! Zorblat.%%%", "Quimfex* quimfex"]
    want = e.plain(texts)
    counted = e.tokenizer = Counted(e.tokenizer)
    try:
        assert e(texts[:1]) + e(texts[1:]) == want
        asked = " ".join(counted.asked).split()
        assert sorted(w for w in asked if w[0].isalpha()) == ["Quimfex", "Zorblat", "Zorblat", "quimfex", "quimfex", "zorblat"]  # two after a space and at a line's start
        counted.asked.clear()
        assert e(texts) == want and not any(counted.asked)
    finally:
        e.tokenizer = counted.tokenizer
    assert token_codes.encoder(text, "b") is not e and not len(token_codes.encoder(text, "b").words)


def test_white_space_is_pythons():
    """All code points, before a letter and after it: what Python or the library may take for white space keeps a text whole."""
    import pyarrow as pa
    import pyarrow.compute as pc

    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for texts in ([c + "a" for c in points], ["a" + c for c in points], ["a" + c + " a" for c in points]):
        found = pc.match_substring_regex(pa.array(texts), token_codes._TOGETHER).to_pylist()
        assert found == [c.isspace() for c in points]


def test_words_are_forgotten_and_asked_again(monkeypatch):
    monkeypatch.setattr(token_codes, "REMEMBERED", 20)
    monkeypatch.setattr(token_codes, "TOGETHER", 7)
    monkeypatch.setattr(token_codes, "ASKED", 50)
    e, rng = Encoder(open(TOKENIZER).read()), random.Random(5)
    bits = ["a", "Be", "é", "ñu", "1", "###", ".", ",$$$", "'s", "'", "!!", "x" * 60, "日", "<|endoftext|>", "endoftext|>", "\x00"]
    for _ in range(40):
        texts = [rng.choice([" ", "\n"]).join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(20)]
        texts += ["", "a  b", " a", "a "]
        assert e(texts) == e.plain(texts)
        assert len(e.words) == len(e.ids) == len(e.used) <= 40 and len(set(e.words.to_pylist())) == len(e.words)
    assert e([]) == [] and e([""]) == [b""] and e(["日"]) == e.plain(["日"])


@pytest.mark.parametrize("added", ["##", "a#", "b", "#a", "<x>", "\U0001f600."])
def test_added_tokens_inside_words(added):
    t, rng = Tokenizer.from_file(TOKENIZER), random.Random(7)
    t.add_tokens([added])
    e = Encoder(t.to_str())
    assert e.apart
    texts = [" ".join("".join(rng.choice(["a", "b", "#", "##", ".", "<", "x>", "\U0001f600"]) for _ in range(rng.randint(1, 5))) for _ in range(8)) for _ in range(300)]
    assert e(texts) == e.plain(texts)


def test_batches_are_gathered():
    import pyarrow as pa

    rows = [pa.RecordBatch.from_pydict({"text": ["x" * n, None]}) for n in (10, 3000, 20, 30, 40)]
    out = list(token_codes.gathered(iter(rows), "text", 400))
    assert [b.num_rows for b in out] == [2, 2, 6] and sum((b.to_pylist() for b in out), []) == sum((b.to_pylist() for b in rows), [])
    assert list(token_codes.gathered(iter([]), "text", 400)) == []


def test_segments_leave_no_shuffle_files(spark, odd):
    """The shuffle that orders the texts is as large as they are; the written segments are read instead."""
    at = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    shuffled = lambda: set(glob.glob(os.path.join(at, "**", "shuffle_*.data"), recursive=True))
    before = shuffled()
    token_codes.encode_table(odd, segment=500)
    for _ in range(50):
        left = shuffled() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
