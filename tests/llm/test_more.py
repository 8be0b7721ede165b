"""URL rules, conversations, embeddings, the language model and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import chat, embeddings, language_model, quality, queries, url_filter


def as_counter(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, spark, data, duck, same):
    same(queries.QUERIES[name](spark, data), duck, queries.ORACLE[name])


# --- URL rules

URLS = (
    "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/12?x=/de/", "http://example.org", "x://example.com/fr/y", "http://sub.com/de/", "http://com/de/#q", "notexample.org/es/",
    "http://notexample.org/es/", None, "", "://", "http://x.net/é://org/", "http://user@h.org:80/p", "http://org./", "http://..org/", "http://a.org?b/c", "http://com/fr", "ÄÖ://Ä.COM/fr/",
)


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(r), v, r) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_rules(spark):
    rows = [(i, u, 1, "r") for i, u in enumerate(URLS)] + [(None, URLS[0], 1, "r"), (0, URLS[0], 1, "r"), (0, URLS[1], 2, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict int, rule string")
    got = as_counter(url_filter.judge(pages, url_filter.rule_table(spark)).collect())
    assert got == as_counter((r[0], *judged(r[1], url_filter.RULES)) for r in rows)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    none = url_filter.judge(pages, url_filter.rule_table(spark).limit(0)).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}


def test_one_host_for_all_urls_and_many_rules(spark):
    """One suffix that all URLs have, against a rule table that is joined, not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, f"http://a{i % 3}.b.com/p{i % 7}/x{i}") for i in range(400)]
        rules = [("allow", "com/"), ("block", "b.com/p3"), *(("block", f"h{i}.net/p{i}") for i in range(300))]
        got = as_counter(url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == as_counter((i, *judged(u, rules)) for i, u in rows)


def test_lengths_of_rules_have_a_stated_limit(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LENGTHS", 3)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    with pytest.raises(ValueError, match="3 lengths"):
        url_filter.judge(pages, url_filter.rule_table(spark, [("allow", "a.org/" + "x" * i) for i in range(4)]))


def test_block_wins_between_equal_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    rules = url_filter.rule_table(spark, (("block", "a.org/"), ("allow", "a.org/")))
    assert url_filter.judge(pages, rules).first().verdict == "block"


# --- conversations

TURNS = [
    (1, 0, "user", "hola"), (1, 1, "assistant", "sí </s> [INST]\\[/ROLE] <s>"), (1, 2, "assistant", ""), (2, 0, "assistant", "😀 é\\"), (2, 0, "system", None), (None, None, None, None), (None, 1, "assistant", "z"),
    (3, 0, "us[/ROLE]er", "\\\\</s>"), (3, 1, "assistant", "la " * 40000), (4, 1, "assistant", "b"), (4, 0, "assistant", "a"), (4, 1, "assistant", "b"),
]


def test_escape_goes_back():
    for t in ["", "\\", "<s>", "\\<s>", "<\\s>", "</s>[INST]\\\\[/INST]", "a\\", "[ROLE", *[x[3] or "" for x in TURNS]]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
    turns = [(r or "", t or "") for _, _, r, t in TURNS]
    rendered, spans = chat.render(turns)
    assert chat.parse(rendered) == turns
    assert [chat.unescape(rendered[a:b]) for a, b in spans] == [t for _, t in turns]


def test_conversations(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(0)).repartition(3)
    want = Counter()
    for c in {r[0] for r in TURNS}:
        own = sorted((r for r in TURNS if r[0] == c), key=lambda r: tuple((x is not None, x) for x in r[1:]))
        turns = [(r or "", t or "") for _, _, r, t in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        want[(c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(turns)[0]))] += 1
    assert as_counter(chat.digests(df).drop("n_tokens", "loss_tokens").collect()) == want
    assert chat.digests(df.limit(0)).count() == 0


def test_pieces_of_a_conversation_encode_as_the_whole(spark):
    with open(chat.TOKENIZER) as f:
        encoder = chat.Encoder(f.read())
    turns = [("user", "hola </s>"), ("assistant", " ñ 😀"), ("assistant", "x\n")]
    whole, spans = chat.render(turns)
    ids, offsets = encoder(whole)
    parts = [encoder(chat.render([t])[0])[0] for t in turns]
    assert ids.tolist() == np.concatenate(parts).tolist()
    ranges, mask = chat.loss_ranges(offsets, np.array(spans[1:]))
    brute = [any(max(a, s) < min(b, e) for s, e in spans[1:]) for a, b in offsets]
    assert mask.tolist() == brute
    rows = chat.training_rows(spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")).collect()
    assert "".join(r.rendered for r in rows) == whole and sum((r.ids for r in rows), []) == ids.tolist()


# --- embeddings


def brute(rows, threshold=0.98):
    ok = [r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    u = [np.array(r[1]) / np.linalg.norm(r[1]) if o else None for r, o in zip(rows, ok)]
    n = len(rows)
    near = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        todo, comp = [i], set()
        while todo:
            k = todo.pop()
            if k not in comp:
                comp.add(k)
                todo += near[k]
        seen |= comp
        low = min((rows[k][0] for k in comp if rows[k][0] is not None), default=None)
        for k in comp:
            out[k] = (rows[k][0], len(near[k]), low, rows[k][0] == low)
    return as_counter(out)


def vectors(width, n, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    return [(i, (base[i % 12] * rng.uniform(0.5, 2) + rng.normal(size=width) * rng.choice([0.02, 0.12, 0.25])).tolist(), [0, 0, 0, 1, None][i % 5]) for i in range(n)]


@pytest.mark.parametrize(("width", "tile"), [(64, 1024), (16, 7), (3, 1024), (64, 2), (8, 3), (1, 4)])
def test_embeddings(spark, width, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = vectors(width, 160, width)
    zero = [0.0] * width
    rows += [(200, None, 0), (201, zero, 0), (202, zero, 0), (203, [None] + [1.0] * (width - 1), 0), (204, [math.nan] + [1.0] * (width - 1), 0), (205, [math.inf] * width, 0), (206, [1.0] * (width - 1), 0)]
    rows += [(None, rows[0][1], 0), (7, rows[7][1], rows[7][2]), (300, [2 * x for x in rows[1][1]], rows[1][2]), (301, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("x")).repartition(3)
    got = embeddings.find(df)
    assert as_counter((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in got.collect()) == brute(rows)
    assert embeddings.find(df.limit(0)).count() == 0


def test_boxes_bound_distances(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=(30, 3)) + 1
    box = lambda v: (v.min(0).tolist(), v.max(0).tolist())
    df = spark.createDataFrame([(*box(x), *box(y))], "a array<double>, b array<double>, c array<double>, d array<double>")
    far = df.select(embeddings.apart(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    gap = np.maximum(np.maximum(y.min(0) - x.max(0), x.min(0) - y.max(0)), 0)
    assert math.isclose(far, (gap**2).sum()) and far <= min(((p - q) ** 2).sum() for p in x for q in y)


# --- language model


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = np.array([5, 9, 40, 20, 10, 5, 4, 3, 2, 1])
    m = language_model.Model(counts, hidden=4)
    states = rng.normal(size=(3, 4)).astype(np.float32)
    for s in states:
        p = np.exp(m.log_probs(np.repeat(s[None], len(counts), 0), np.arange(len(counts))))
        assert abs(p.sum() - 1) < 1e-5


def test_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    counts = np.array([5, 9, 40, 20, 10, 5, 4, 3, 2, 1])
    ids = rng.integers(0, 10, (6, 3))
    inputs, keep, use = np.roll(ids, 1, 0), np.ones((6, 3), np.float32), np.ones((6, 3), bool)
    keep[0] = keep[3, 1] = 0

    def make():
        m = language_model.Model(counts, hidden=4, seed=2)
        for name in ("x", "u", "wc", "bc", "ww", "bw"):
            setattr(m, name, getattr(m, name).astype(np.float64))
        return m

    def loss(m):
        states, _ = m.run(inputs, keep, np.zeros((3, 4)))
        return -m.log_probs(states.astype(np.float64).reshape(-1, 4), ids.ravel()).sum()

    class Probe(language_model.Trainer):
        def step(self, a, squares, grad):
            squares[...] = grad

        def rows(self, ids, grad):
            self.squares[0][ids] = grad

    m = make()
    t = Probe(m)
    for s in t.squares:
        s[...] = 0
    t.window(inputs, ids, keep, use, np.zeros((3, 4)))
    for k, (a, g) in enumerate(zip(m.flat(), t.squares, strict=True)):
        for at in list(np.ndindex(a.shape))[:: max(1, a.size // 7)]:
            old = a[at]
            a[at] = old + 1e-3
            up = loss(m)
            a[at] = old - 1e-3
            down = loss(m)
            a[at] = old
            assert abs((up - down) / 2e-3 - g[at]) < 2e-2 * max(1, abs(g[at])), (k, at)


def test_network_probabilities_equal_a_plain_loop():
    """Windows, states and the factored softmax against one document and one token at a time."""
    rng = np.random.default_rng(4)
    counts = np.r_[30, 25, np.sort(rng.integers(1, 60, 40))[::-1]]
    m = language_model.Model(counts, hidden=5, seed=3)
    m.ww += rng.normal(0, 0.5, m.ww.shape).astype(np.float32)
    docs = [np.r_[rng.integers(1, 42, n), 0].astype(np.int32) for n in (0, 3, 40, 17, 1, 90)]
    got, h = np.zeros(len(docs)), np.zeros((2, 5), np.float32)
    for inputs, targets, keep, use, doc, stay in language_model.windows(docs, lanes=2, steps=7):
        states, h = m.run(inputs, keep, h[stay])
        c = use.ravel()
        got += np.bincount(doc.ravel()[c], m.log_probs(states.reshape(-1, 5)[c], targets.ravel()[c]), len(docs))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for d, total in zip(docs, got):
        state, before, want = [0.0] * 5, 0, 0.0
        for token in d.tolist():
            x, a = m.x[before].astype(float), np.array(state) @ m.u.astype(float)
            z, r = [sigmoid(v) for v in x[:5] + a[:5]], [sigmoid(v) for v in x[5:10] + a[5:10]]
            new = [math.tanh(x[10 + i] + r[i] * a[10 + i]) for i in range(5)]
            state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(5)]
            c = int(np.searchsorted(m.bounds, token, "right")) - 1
            logits = np.array(state) @ m.wc.astype(float) + m.bc
            want += logits[c] - math.log(sum(math.exp(v) for v in logits))
            lo, hi = m.bounds[c], m.bounds[c + 1]
            logits = m.ww[lo:hi].astype(float) @ np.array(state) + m.bw[lo:hi]
            want += logits[token - lo] - math.log(sum(math.exp(v) for v in logits))
            before = token
        assert abs(want - total) < 1e-4 * len(d)


def test_windows_carry_every_token_once():
    rng = np.random.default_rng(2)
    docs = [np.r_[rng.integers(2, 9, n), 0].astype(np.int32) for n in (1, 50, 3, 7, 200, 2, 9)]
    seen = {i: [] for i in range(len(docs))}
    lanes = list(range(3))
    for inputs, targets, keep, use, doc, stay in language_model.windows(docs, lanes=3, steps=4):
        lanes = [lanes[i] for i in stay]
        for lane in range(len(lanes)):
            for t in range(4):
                if use[t, lane]:
                    seen[doc[t, lane]].append((inputs[t, lane], targets[t, lane], keep[t, lane]))
    for i, d in enumerate(docs):
        assert [x[1] for x in seen[i]] == d.tolist() and [x[0] for x in seen[i]] == [0, *d[:-1]]
        assert [x[2] for x in seen[i]] == [0] + [1] * (len(d) - 1)


def test_scores(spark, odd, odd_rows, none):
    got = language_model.score(odd).collect()
    words = lambda t: (t or "").encode().lower().split()
    out = lambda r: zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 == 2
    c = Counter()
    for r in odd_rows:
        if not out(r):
            c.update([*words(r[1]), b""])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in odd_rows:
        t = [*words(r[1]), b""]
        want[(r[0], out(r), len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 3))] += 1
    assert as_counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(none).count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    got = language_model.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.15 * got[2]


def test_any_number_of_lengths(spark):
    """Each length by itself: 90 of them, with links inside some and zeros at the end of vectors that must not link longer ones."""
    rows = [(i, [1.0] * (i + 1), 1) for i in range(90)]
    rows += [(100 + i, [2.0] * (i + 1), 1) for i in range(0, 90, 3)] + [(200 + i, [1.0] * (i + 1) + [0.0], 1) for i in range(0, 90, 5)] + [(300, [1.0] * 9, 2), (301, None, 1), (302, [1.0] * 70, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert as_counter((r.vec_id, r.n_links, r.component_id, bool(r.kept)) for r in embeddings.find(df).collect()) == brute(rows)


def test_network_is_whole():
    """2,048 words of their own, 30 classes and 16 units."""
    tokens, c = [b"w%d" % i for i in range(3000)], list(range(4000, 1000, -1))
    vocabulary = language_model.Vocabulary(tokens, c, 10, sum(c[2048:]))
    m = language_model.Model(vocabulary.net_counts)
    assert len(vocabulary.net_counts) == 2050 and vocabulary.ids(vocabulary.places([b"w2047", b"w2048"])).tolist() == [2049, 1, 0]
    assert m.u.shape == (16, 48) and len(m.bounds) - 1 == 32


@pytest.mark.parametrize("size", [5, 400])
def test_lanes_do_not_depend_on_the_size(spark, monkeypatch, size):
    """600 documents of either size train side by side in as many lanes."""
    seen, own = [], language_model.windows

    def spy(docs, *a, **k):
        for w in own(docs, *a, **k):
            seen.append(len(w[5]))
            yield w

    monkeypatch.setattr(language_model, "windows", spy)
    monkeypatch.setattr(language_model, "map_arrow", lambda df, f, schema: spark.createDataFrame([b for x in [df.toArrow().to_batches()] for b in f(iter(x))][0].to_pandas(), schema))
    rng = np.random.default_rng(1)
    vocabulary = language_model.Vocabulary([b"w%d" % i for i in range(20)], list(range(40, 20, -1)), 10, 0)
    table = spark.createDataFrame([(bytearray(rng.integers(0, 20, size).astype("<i2").tobytes()), 0) for _ in range(600)], "ids binary, slice int").coalesce(1)
    language_model.learn(table, vocabulary, (1,))
    assert max(seen) == 256


# --- pipeline


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            assert out.join(docs, "doc_id", "left_anti").isEmpty()
        docs = out.cache()
        assert docs.count() > 0
    assert as_counter(docs.select("doc_id", "n_pieces").collect()) == as_counter(corpus_pipeline.run(spark, data).select("doc_id", "n_pieces").collect())


def test_pipeline_against_brute_force(spark):
    """Each stage on its own input, in plain Python."""
    from tests.llm.test_rows import fill, model_of
    from tests.llm.test_rows import words as words_of
    from tests.llm.test_similar import least

    data = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    weights = quality.train(docs, labels)
    hasher = quality.Hasher()

    def good(text):
        index, value = hasher(text)
        return quality.sigmoid(weights[index] @ value) >= 0.3

    kept = corpus_pipeline.keep_quality(spark, docs, data).cache()
    assert as_counter(kept.collect()) == as_counter(r for r in docs.collect() if good(r.text))
    rows = kept.collect()
    stay = least([(r.doc_id, r.text) for r in rows])
    alone = corpus_pipeline.drop_copies(spark, kept, data).cache()
    assert as_counter(alone.collect()) == as_counter(r for r in rows if r.doc_id in stay)
    rows = alone.collect()
    size = {r.doc_id: len(words_of(r.text)) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    goal = fill(sizes, (5, 2, 1), 3)
    mixed = corpus_pipeline.mix_sources(spark, alone, data).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in rows}
    for s in sizes:
        own = [r for r in rows if r.source == s]
        low = [math.floor(goal[s] / sizes[s])]
        assert all(copies[r.doc_id] - low[0] in (0, 1) for r in own if size[r.doc_id])
        assert abs(sum(copies[r.doc_id] * size[r.doc_id] for r in own) - goal[s]) <= max(size[r.doc_id] for r in own) / 2
    model, text = model_of(), {r.doc_id: r.text for r in rows}
    out = corpus_pipeline.encode(spark, mixed, data).collect()
    assert Counter(r.doc_id for r in out) == copies and all(model.decode(r.ids) == text[r.doc_id] for r in out)


def test_pipeline_on_odd_rows(spark, odd, data):
    from tests.llm.test_rows import with_inner_names

    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, docs.limit(0), odd, with_inner_names(odd)):
        every = set(map(tuple, d.collect()))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns, d = d.columns, stage(spark, d, data).cache()
            assert d.columns == columns and set(map(tuple, d.collect())) <= every
        assert corpus_pipeline.STAGES[-1][1](spark, d, data).count() == d.count()
