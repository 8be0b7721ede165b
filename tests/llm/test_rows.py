"""The operators on rows against brute force, over odd rows and none."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanery.llm import media, mixing, pieces, quality, sharding, simhash


def words(t):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]


def as_counter(rows):
    return Counter(map(tuple, rows))


# --- sharding


def test_permutation_is_one_and_goes_back():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = sharding.permute(np.arange(n), n, seed=3)
        assert sorted(p) == list(range(n))
        assert (sharding.permute(p, n, seed=3, back=True) == np.arange(n)).all()
    p = sharding.permute(np.arange(20000), 20000)
    assert abs(np.corrcoef(p, np.arange(20000))[0, 1]) < 0.05


def test_shards(spark, odd, odd_rows, none):
    got = sharding.shard(odd, 4).collect()
    want = as_counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert as_counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    n = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in n) and max(map(len, n)) - min(map(len, n)) <= 1
    assert sorted(r.row_number for r in got) == list(range(len(odd_rows)))
    place = sharding.permute(np.arange(len(odd_rows)), len(odd_rows))
    assert all((r.shard, r.slot) == (place[r.row_number] % 4, place[r.row_number] // 4) for r in got)
    again = sharding.shard(odd.repartition(1), 4).collect()
    assert as_counter(got) == as_counter(again)
    assert sharding.shard(none, 4).count() == 0


def test_many_copies_come_in_blocks(spark, monkeypatch):
    from gleanery.llm import common

    monkeypatch.setattr(common, "COPIES", 7)
    same = spark.createDataFrame([(1, "x")] * 100 + [(2, "y")], "doc_id long, text string")
    got = sharding.shard(same, 4).collect()
    assert sorted(r.row_number for r in got) == list(range(101)) and Counter(r.doc_id for r in got) == {1: 100, 2: 1}
    from pyspark.sql import functions as F

    none = spark.createDataFrame([(0,), (15,)], "n long")
    assert sorted(r.i for r in common.repeated(none, F.col("n"), "i").collect()) == list(range(15))


# --- mixing


def fill(sizes, weights, most):
    """Targets by resharing excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_mix(spark, odd, odd_rows, none):
    got = mixing.mix(odd).collect()
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(words(r[1]))
    assert as_counter((r.doc_id, r.source, r["size"]) for r in got) == as_counter((r[0], r[3], len(words(r[1]))) for r in odd_rows)
    want = fill(sizes, (5, 2, 1), 3)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r["size"] and r.taken <= 3 * r["size"] and len(r.positions) == (r.copies if r["size"] else 0)
        assert all(0 <= x <= 1 for x in r.positions)
        taken[r.source] += r.taken
    for s in sizes:
        largest = max((len(words(r[1])) for r in odd_rows if r[3] == s), default=0)
        assert abs(taken[s] - want[s]) <= largest / 2 + 1
    assert as_counter((r.doc_id, r["size"], r.taken) for r in got) == as_counter((r.doc_id, r["size"], r.taken) for r in mixing.mix(odd.repartition(1)).collect())
    assert mixing.mix(none).count() == 0
    rows = mixing.take(odd)
    assert rows.columns == odd.columns
    assert as_counter(rows.select("doc_id", "text").collect()) == sum((Counter({(r[0], r[1]): 0}) for r in odd_rows), Counter()) + as_counter(
        (r.doc_id, t) for r in mixing.mix(odd, carry=True).collect() for t in [r._row.text] * len(r.positions)
    )


def test_mix_close_targets_and_order(spark):
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["w"] * int(n)), f"s{i % 5}") for i, n in enumerate(rng.integers(1, 60, 3000))]
    got = mixing.training_order(mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))).collect()
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.005 * own[0].target


def test_demand_time_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for slope in (-1.0, -0.3, 0.0, 0.7, 1.0):
        for q in (0.0, 0.2, 0.9, 1.0):
            t = spark.range(1).select(mixing.demand_time(F.lit(q), F.lit(slope))).first()[0]
            assert abs(t + slope * (t * t - t) - q) < 1e-9


def test_schedules_are_integrated_and_inverted(spark):
    """Sources with schedules of their own: shares by their integrals, positions by the inverse of the running integral."""
    rng = np.random.default_rng(0)
    docs = [(i, " ".join(["w"] * int(n)), ("a", "b", None)[i % 3]) for i, n in enumerate(rng.integers(1, 40, 3000))]
    plan = {"a": [(0.0, 4.0), (0.5, 0.0), (1.0, 0.0)], "b": [(0.25, 0.0), (1.0, 3.0)], None: [(0.3, 2.0)]}
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), schedules=plan).collect()
    area = {"a": 1.0, "b": 1.125, None: 2.0}
    want = {}
    sizes = Counter()
    for r in got:
        sizes[r.source] += r["size"]
    total = sum(sizes.values())
    for s in area:
        want[s] = total * area[s] / sum(area.values())
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 * total and abs(sum(r.taken for r in own) - want[s]) < 0.01 * want[s]
        words, times = 0, sorted((x, r["size"]) for r in own for x in r.positions)
        grid = np.linspace(0, 1, 2001)
        w = np.interp(grid, [t for t, _ in plan[s]], [v for _, v in plan[s]])
        c = np.r_[0, np.cumsum((w[1:] + w[:-1]) / 2)] / 2000 / area[s]
        for x, n in times[:: len(times) // 40]:
            before = sum(m for y, m in times if y < x)
            assert abs(np.interp(x, grid, c) - before / want[s]) < 0.01
    with pytest.raises(ValueError, match="schedule"):
        mixing.schedule_table(spark, {"a": [(2.0, 1.0)]})


def test_null_ids_do_not_gather(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    assert mixing.mix(docs).where("taken > 0").count() == 500
    assert [r.taken for r in mixing.mix(docs.limit(3).selectExpr("doc_id", "' ' as text", "source")).collect()] == [0, 0, 0]
    from pyspark.sql import functions as F

    assert docs.select(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")))).distinct().count() == 500


# --- near-duplicates


def fingerprint(t):
    w = words(t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, t):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= t:
            root[find(j)] = find(i)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_groups(spark, odd, odd_rows, none):
    got = as_counter(simhash.near_duplicates(odd).collect())
    fps = [fingerprint(r[1]) for r in odd_rows]
    root = groups(fps, 4)
    low = {}
    for r, g in zip(odd_rows, root, strict=True):
        low[g] = min((x for x in (low.get(g), r[0]) if x is not None), default=None)
    assert got == as_counter((r[0], f"{f:016x}", low[g]) for r, f, g in zip(odd_rows, fps, root, strict=True))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    kept = kept.collect()
    assert len(kept) == len(set(root)) and sorted(r.doc_id for r in kept) == sorted(low.values())
    assert as_counter(kept) <= as_counter(odd_rows)
    assert simhash.deduplicate(none).count() == 0


INNER = "_fp _fp_ fp id row rank _id _keep_fp component_id _stay _rank _score _score_ _row _key _hash size _low _root".split()


def with_inner_names(odd):
    from pyspark.sql import functions as F

    return odd.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{n} "), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in INNER))


def test_columns_with_inner_names_keep_their_values(spark, odd):
    """Every name that the operators use inside, as a column of texts."""
    import corpus_pipeline
    from gleanery.llm import quality as q

    own = with_inner_names(odd)
    every = as_counter(own.collect())
    for out in (simhash.deduplicate(own), simhash.with_fingerprint(own, name="added").drop("added"), q.with_score(own, np.zeros(1 << q.BITS), name="added").drop("added"), corpus_pipeline.keep_quality(spark, own, "/root/testdata/sf0.001")):
        assert out.columns == own.columns
        assert as_counter(out.collect()) <= every
    mixed = mixing.take(own)
    assert mixed.columns == own.columns and set(map(tuple, mixed.collect())) <= set(every)


@pytest.mark.parametrize("block", [8, 100_000])
def test_links_join_what_brute_force_joins(spark, block):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 6)).astype(np.uint64)) for b in base for _ in range(6)]
    dense = [base[0] ^ np.uint64(i) for i in range(200)]
    fps = sorted({int(x) for x in [*base, *near, *dense]})
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    links = [(int(np.int64(r.a).astype(np.uint64)), int(np.int64(r.b).astype(np.uint64))) for r in simhash.fingerprint_links(df, 4, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = groups(fps, 4)
    by_want, by_got = {}, {}
    for x, g in zip(fps, want, strict=True):
        by_want.setdefault(g, set()).add(x)
        by_got.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, by_want.values())) == sorted(map(sorted, by_got.values()))


# --- pieces


def model_of():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


@pytest.fixture(scope="module")
def model():
    return model_of()


def all_paths(model, s):
    out = []

    def go(i, score, ids):
        if i == len(s):
            out.append((score, tuple(ids)))
            return
        for j, w, x in model.edges(s, i):
            go(j, score + w, [*ids, *x])

    go(0, 0, [])
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_brute_force(model):
    rng = np.random.default_rng(2)
    for _ in range(150):
        t = "".join(rng.choice(list("the ining aoé\n"), rng.integers(1, 11)))
        got = model.encode(t, 4)
        want = all_paths(model, pieces.SPACE + t.replace(" ", pieces.SPACE))[:4]
        assert [round(s * pieces.SCALE) for s, _ in got] == [s for s, _ in want]
        assert len({i.tobytes() for _, i in got}) == len(got) and all(model.decode(i) == t for _, i in got)


def test_pieces_round_trip(spark, odd, odd_rows, none, model):
    for r in odd_rows:
        assert model.decode(model.encode(r[1], 1)[0][1]) == (r[1] or "")
    got = pieces.encode_table(odd).collect()
    assert all(r.decoded for r in got) and as_counter((r.doc_id, r.n_pieces) for r in got) == as_counter((r[0], len(model.encode(r[1], 1)[0][1])) for r in odd_rows)
    assert all(list(map(lambda x: x.score, r.n_best)) == sorted((x.score for x in r.n_best), reverse=True) and len(r.n_best) <= 4 for r in got)
    assert pieces.encode_table(none).count() == 0


def test_n_best_tables_decode_to_their_texts(spark, odd, odd_rows, none, model):
    got = pieces.n_best_table(odd)
    want = Counter((r[0], k, s, tuple(ids.tolist())) for r in odd_rows for k, (s, ids) in enumerate(model.encode(r[1], 4), 1))
    assert Counter((r["doc_id"], r["rank"], r["score"], tuple(r["ids"])) for r in got.collect()) == want
    # every one of the n best gives its document's text; a column of the same name is replaced
    back = pieces.decode_table(got.withColumn("text", F.lit("old")))
    assert back.columns == ["doc_id", "rank", "score", "ids", "text"]
    assert Counter((r["doc_id"], r["rank"], r["text"]) for r in back.collect()) == Counter((r[0], k, r[1] or "") for r in odd_rows for k in range(1, len(model.encode(r[1], 4)) + 1))
    assert pieces.n_best_table(none).count() == 0 and pieces.decode_table(got.limit(0)).count() == 0


def test_decode_table_on_odd_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "x long, ids array<int>")
    assert {r["x"]: r["text"] for r in pieces.decode_table(rows).collect()} == {1: None, 2: ""}
    for wrong in ([10**6], [-1], [None]):
        with pytest.raises(Exception, match="no piece has the id"):
            pieces.decode_table(spark.createDataFrame([(wrong,)], "ids array<int>")).collect()


def test_long_word_without_end(model):
    s, ids = model.encode("a" * 20000, 4)[3]
    assert model.decode(ids) == "a" * 20000


# --- media


def test_cuts_equal_a_rolling_hash_byte_by_byte():
    rng = np.random.default_rng(5)
    for n in (0, 1, 31, 32, 1500, 5000, 40000):
        data = rng.integers(97, 101 if n % 2 else 255, n, np.uint8).tobytes()
        h, start, ends = 0, 0, []
        for i, b in enumerate(data):
            h = ((h << 1) + int(media._GEAR[b])) & 0xFFFFFFFF  # older bytes leave by the shift
            size = i + 1 - start
            if i + 1 < n and size >= media.LEAST and (h >> (32 - media.BITS) == 0 or size == media.MOST):
                ends.append(i + 1)
                start = i + 1
        assert media.cuts(data) == [*ends, n][: None if n else 0]


def test_chunks_follow_content():
    rng = np.random.default_rng(3)
    data = rng.integers(32, 127, 60000, np.uint8).tobytes()
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST
    own = lambda d, e: {d[a:b] for a, b in zip([0, *e], e)}
    moved = b"in front of it" + data
    assert len(own(data, ends) & own(moved, media.cuts(moved))) > len(ends) / 2


def test_media(spark, odd, odd_rows, none):
    got = as_counter(media.media_column(odd).drop("feature").collect())
    want = Counter()
    for r in odd_rows:
        data = (r[1] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        ends = media.cuts(payload)
        chunks = [payload[a:b] for a, b in zip([0, *ends], ends)]
        box = media.container(chunks, [media.digest(c) for c in chunks])
        assert media.open_container(box) == payload
        want[(r[0], len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(box), hashlib.sha256(box).hexdigest())] += 1
    assert got == want
    assert media.media_column(none).count() == 0


def test_payloads_come_back_byte_by_byte(spark, odd, odd_rows, none):
    """One row a payload, whatever its documents: the bytes, and a container that opens to them."""
    listed = media.manifest(odd, "doc_id", "text").cache()
    got = {bytes(r["key"]): r for r in media.payloads(media.store(odd, listed, "text")).collect()}
    made = [(r[1] or "").encode() for r in odd_rows]
    want = {d + b"\xff" * (-len(d) % 576 if d else 576) for d in made}
    assert Counter(bytes(r["payload"]) for r in got.values()) == Counter(want)
    assert all(media.open_container(bytes(r["media"])) == bytes(r["payload"]) for r in got.values())
    by_id = listed.where("doc_id = 36").first()
    assert bytes(got[bytes(by_id["key"])]["payload"])[: by_id["n_bytes"]].decode() == dict((r[0], r[1]) for r in odd_rows)[36]
    assert media.payloads(media.store(none, media.manifest(none, "doc_id", "text"), "text")).count() == 0


def test_each_chunk_is_stored_once(spark):
    rng = np.random.default_rng(4)
    part = bytes(rng.integers(97, 123, 30000, np.uint8)).decode()
    docs = spark.createDataFrame([(1, "x " * 900 + part), (2, part + " y" * 700), (3, part)], "doc_id long, text string")
    listed = media.manifest(docs, "doc_id", "text").cache()
    kept = media.store(docs, listed, "text")
    all_ = [c.d for r in listed.collect() for c in r.chunks]
    own = [c.d for r in kept.collect() for c in r.recipe if c.own]
    assert len(own) == len(set(own)) == len(set(all_)) < len(all_)
    assert sum(len(r.blob) for r in kept.collect()) < 1.5 * len(part)
    assert media.read_back(kept).count() == 3


def test_common_chunks_are_dealt_out(spark, monkeypatch):
    """A chunk that nearly all payloads share: its uses go over several parts, and results stay."""
    rng = np.random.default_rng(4)
    part = bytes(rng.integers(97, 123, 20000, np.uint8)).decode()
    docs = spark.createDataFrame([(i, part + f" {i} " * 100) for i in range(60)] + [(99, None)], "doc_id long, text string")
    want = as_counter(media.media_column(docs).collect())
    monkeypatch.setattr(media, "HOT", 5)
    listed = media.manifest(docs, "doc_id", "text").cache()
    from pyspark.sql import functions as F

    uses = listed.select("key", F.explode("chunks").alias("c")).select("key", "c.d")
    common = media.common_chunks(uses)
    assert common
    joined = media.chunk_join(uses, uses.select("d").distinct().withColumn("one", F.lit(1)), common)
    assert joined.count() == uses.count()
    assert as_counter(media.media_column(docs).collect()) == want


def test_damage_is_found():
    box = media.container([b"abc", b"de"], [media.digest(b"abc"), media.digest(b"de")])
    with pytest.raises(ValueError, match="digest"):
        media.open_container(box[:-1] + b"?")


# --- quality


def test_quality(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 1), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(odd, labels)
    got = quality.classify(odd, w).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in got)
    again = quality.classify(odd.repartition(1), quality.train(odd.repartition(5), labels)).collect()
    assert as_counter((r.doc_id, round(r.score, 9)) for r in got) == as_counter((r.doc_id, round(r.score, 9)) for r in again)
    assert quality.classify(none, w).count() == 0
    blank = quality.classify(odd, quality.train(odd, labels.limit(0))).collect()
    assert {r.score for r in blank} == {0.5}


def test_training_equals_plain_ftrl():
    """Weights of the online learner against dictionaries and one feature at a time."""
    import random

    rng = random.Random(3)
    examples = [(" ".join(rng.choice(("aa bb cc dd ee" if y else "bb vv ww xx yy").split()) for _ in range(rng.randint(0, 9))), y) for y in (0, 1) * 8]
    got = quality.fit(examples, bits=12, epochs=2, alpha=0.3, beta=1.0, l1=0.02, l2=0.05)
    z, n, hasher = {}, {}, quality.Hasher(12)

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= 0.02 else -(zi - (0.02 if zi > 0 else -0.02)) / ((1.0 + ni**0.5) / 0.3 + 0.05)

    for _ in range(max(2, quality.LEAST_STEPS // len(examples))):
        for text, y in examples:
            x = {}
            for i, v in zip(*hasher(text)):
                x[int(i)] = x.get(int(i), 0.0) + float(v)
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.3
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    want = np.zeros(1 << 12)
    for i in z:
        want[i] = weight(i)
    assert np.abs(want).max() > 0 and np.allclose(got, want, rtol=1e-6, atol=1e-9)


def test_repeated_ids_do_not_grow_the_sample(spark):
    docs = spark.createDataFrame([(i % 4 + 1, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, quality int")
    seen = []
    own, quality.map_arrow = quality.map_arrow, lambda df, f, schema: (seen.append(df.count()), own(df, f, schema))[1]
    try:
        quality.train(docs, labels)
    finally:
        quality.map_arrow = own
    assert seen and seen[0] <= 4


def test_quality_learns_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.93
    assert all(r.predicted == 1 for r in got if r.quality == 1)


def test_quality_ignores_ids_and_sources(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    w = quality.train(odd, labels)
    from pyspark.sql import functions as F

    a = {r.text: r.q for r in quality.with_score(odd.select("text"), w, name="q").collect()}
    b = {r.text: r.q for r in quality.with_score(odd.withColumn("doc_id", F.col("doc_id") + 99).withColumn("source", F.lit("z")), w, name="q").collect()}
    assert a == b
