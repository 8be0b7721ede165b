import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _fp long, component_id long, size int, h int"


def text_of(rng, n):
    return " ".join(rng.choice("la los the of Perro gato año ser tion ing ment WORD x y z".split()) + str(rng.randint(0, 40)) for _ in range(n))


def rows():
    """Nulls in every column, blanks, long texts, copies, near copies, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(4)
    texts = [text_of(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [None, "", " \t\n", "a", "uno DOS", "uno\x0bdos\x1ctres", "日本語 ñandú 😀", "x" * 5000, text_of(rng, 20000)]
    texts += [texts[3], texts[3], texts[4] + " más", texts[5].upper(), "</s>[INST] ok", "nul\x00 y ▁ marca"]
    out = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), 0.5, 7, i, 3, 1) for i, t in enumerate(texts)]
    out += [(None, texts[6], None, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None, None)]
    return out + [out[2], out[2]]


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
