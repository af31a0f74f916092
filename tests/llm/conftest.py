"""Small awkward tables that every operator has to cope with."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, score double, `odd name.x` string, words string, _part int"


def make_docs(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, 0.5, "x", "y", 3) for i, t, lang, src in rows], DOCS)


def vocabulary(lang):
    pools = {"en": ["the", "and", "of", "to", "water", "river", "house", "with", "thing", "over", "north", "stone", "field", "light", "under"],
             "de": ["der", "und", "nicht", "wasser", "fluss", "haus", "mit", "schön", "über", "nordwind", "stein", "feld", "licht", "unter", "auch"]}
    return pools[lang]


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(vocabulary(lang)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): clean, copied, repeated, empty, null and very long texts, null ids and ties."""
    out = [(i, prose("en" if i % 3 else "de", 60 + i % 50, i), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    shared = prose("en", 40, 999)
    out += [(100 + i, f"{prose('en', 30, 500 + i)}\n{shared} {prose('en', 20, 700 + i)}", "en", "hot") for i in range(30)]
    out += [(200 + i, out[5][1], "en", "hot") for i in range(40)]
    out += [(300, None, None, None), (301, "", "en", None), (302, "   \n\t ", "de", "s1"), (303, "one", "en", "s1"), (304, "One two", None, "s1"),
            (305, "12 34 -- !!", "en", "s2"), (306, prose("de", 30_000, 77), "de", "s2"), (307, "a b c d e f g " * 300, "en", "s3"),
            (308, "same line\nsame line\n\nother\nsame line", "en", "s3"), (309, "İ é \u00a0ü\u2003x ß 🙂 \x0b\x0c end", "en", "s3"),
            (None, "null id text here", "en", "s3"), (None, None, None, None), (5, out[5][1], "en", "s1"), (5, out[5][1], "en", "s1")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return make_docs(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make_docs(spark, [])
