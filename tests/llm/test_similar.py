"""Near-duplicates by similarity, against all pairs in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import similar


def shingles(text, k=5):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else frozenset()


def alike(texts):
    """A group's number for each text: all pairs of similarity 0.8 or more, followed."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b) > 0:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def least(rows):
    """The ids that stay, None for a group without any."""
    low = {}
    for r, g in zip(rows, alike([r[1] for r in rows]), strict=True):
        low[g] = min((x for x in (low.get(g), r[0]) if x is not None), default=None)
    return Counter(low.values())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def families(rng, n=12, size=8):
    """Texts of 1 to 200 words, each with copies that differ in some of their words: similarities on both sides of 0.8."""
    texts = []
    for _ in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 5, 6, 9, 30, 90, 200]))]
        texts += [edited(rng, words, rng.randrange(1 + len(words) // 25)) for _ in range(size)]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_those_who_stay_are_brute_force_s(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(families(rng)))
    got = similar.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == least(rows) and {tuple(r) for r in got} <= set(rows)


def test_odd_rows(spark, odd, odd_rows, none):
    got = similar.deduplicate(odd)
    assert got.columns == odd.columns
    got = got.collect()
    assert Counter(r.doc_id for r in got) == least(odd_rows) and not Counter(map(tuple, got)) - Counter(odd_rows)
    assert similar.deduplicate(none).count() == 0


def test_inner_names_keep_their_values(spark, odd):
    from pyspark.sql import functions as F

    names = "row key uid root node h m n place fp tile mine blocks shingles text_ id".split()
    own = odd.select("doc_id", "text", *(F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names))
    got = similar.deduplicate(own)
    assert got.columns == own.columns and set(map(tuple, got.collect())) <= set(map(tuple, own.collect()))


@pytest.mark.parametrize("block, group", [(4, 500), (1, 50)])
def test_blocks_lose_no_link(spark, monkeypatch, block, group):
    """One passage in all texts and one large family: places and groups are dealt out in pairs of blocks."""
    rng = random.Random(3)
    words = [f"c{i}" for i in range(60)]
    texts = [edited(rng, words, rng.randrange(3)) for _ in range(60)] + [" ".join(words[:20]) + f" {t}" for t in families(rng, 6, 5)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string").repartition(3)
    root = {r.node: r.root for r in similar.groups(rows, block, group).collect()}
    want = alike(texts)
    low = {}
    for i, g in enumerate(want):
        low.setdefault(g, i)
    assert [root.get(i, i) for i in range(len(texts))] == [low[g] for g in want]


def test_prefix_holds_a_shared_shingle():
    """Of two sets at the similarity, at least one shared element is among the first of both, in any order."""
    rng = random.Random(5)
    for _ in range(300):
        n, extra = rng.randrange(1, 60), rng.randrange(0, 8)
        a = set(range(n))
        b = set(rng.sample(range(n), n - rng.randrange(0, n // 5 + 1))) | {1000 + i for i in range(extra)}
        if 5 * len(a & b) >= 4 * len(a | b):
            order = {x: rng.random() for x in a | b}
            first = [set(sorted(s, key=order.get)[: similar.prefix_length(len(s))]) for s in (a, b)]
            assert first[0] & first[1]


def test_filter_equals_its_definition():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 2000, np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 40, 2000)]
    b, n, m = a ^ np.array(flips, np.uint64), rng.integers(70, 100, 2000), rng.integers(70, 100, 2000)
    want = [(int(x) ^ int(y)).bit_count() <= 24 and 5 * min(i, j) >= 4 * max(i, j) for x, y, i, j in zip(a, b, n, m, strict=True)]
    assert similar.may_be_similar(a, n, b, m).tolist() == want
    assert similar.may_be_similar(a, n, b[0], m[0]).tolist() == [(int(x) ^ int(b[0])).bit_count() <= 24 and 5 * min(i, int(m[0])) >= 4 * max(i, int(m[0])) for x, i in zip(a, n, strict=True)]


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(families(random.Random(7), 6))), "key long, text string").selectExpr("xxhash64(key) key", "text")
    want = Counter(map(tuple, similar.groups(rows).collect()))
    plain = similar._new
    monkeypatch.setattr(similar, "_new", lambda batches, bitmap=None: plain(batches, None if bitmap is None else ~np.zeros_like(bitmap)))
    assert want and Counter(map(tuple, similar.groups(rows).collect())) == want


def test_chance_meetings_make_no_large_group(spark):
    """Each text shares passages with some 40 others and is similar to none: of these that meet, few may be gathered. With one word of fingerprint more than
    half hang together, and a group's sets are dealt out in pairs of blocks."""
    rng = random.Random(11)
    n, each = 300, 40
    texts = [[] for _ in range(n)]
    ends = [i for i in range(n) for _ in range(each)]
    rng.shuffle(ends)
    for p, (i, j) in enumerate(zip(ends[::2], ends[1::2], strict=True)):
        for t in {i, j}:
            texts[t].append(" ".join(f"p{p}w{w}" for w in range(40)))
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "key long, text string").repartition(3)
    places = similar.meetings(rows, similar.frequencies(rows)).repartition("place").sortWithinPartitions("place")
    links = places.mapInArrow(similar._met, "a long, b long").collect()
    assert len({x for link in links for x in link}) < n // 10


@pytest.mark.parametrize("most", [similar.__dict__.get("GONE"), 0])
def test_rows_that_go_are_taken_out_without_a_shuffle_of_the_rest(spark, monkeypatch, most):
    rows = list(enumerate(families(random.Random(12), 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "GONE", most, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = similar.deduplicate(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        ids = Counter(r.doc_id for r in got.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ids == least(rows)
    assert ("Exchange hashpartitioning" in plan) == (most == 0)


def test_bitmap_of_rows_that_go(spark):
    """Numbers at the ends of words and of partitions, the sign bit among them."""
    uids = [0, 1, 62, 63, 64, 65, 127, 128, (1 << 33) - 1, 1 << 33, (1 << 33) + 63, (5 << 33) + 64]
    rows, gone = spark.createDataFrame([(u,) for u in uids], "uid long"), uids[::2] + [63]
    got = similar.without(rows, spark.createDataFrame([(u,) for u in gone], "uid long"))
    assert got.columns == ["uid"] and sorted(r.uid for r in got.collect()) == sorted(set(uids) - set(gone))


def test_finished_queries_leave_no_shuffle_files(spark):
    import glob

    from gleanery.llm.common import written

    held = lambda: len(glob.glob(f"{spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()[0].getPath()}/*/shuffle_*.data"))
    before, now = spark.conf.get(similar.CLEANUP), held()
    with similar._lean(spark):
        written(spark.range(1000).repartition(3, "id"))
    import time

    for _ in range(50):
        if held() <= now:
            break
        time.sleep(0.1)
    assert held() <= now and spark.conf.get(similar.CLEANUP) == before
