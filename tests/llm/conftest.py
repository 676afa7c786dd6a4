import pytest

WORDS = {
    "en": "the and of to in is was that for it with as his on be at by had not are but from or have an they which one you were all her she there would their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas avec ce il sont cette mais son ou nous était très été".split(),
}


def prose(lang, n, seed):
    import random

    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) + ("." if r.random() < 0.08 else "") for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with everything that may go wrong: nulls, empty and long texts, copies, repeated rows, clashing names."""
    rows = [(i, prose(lang := ["en", "de", "fr"][i % 3], 40 + i, i), lang, f"src{i % 2}") for i in range(24)]
    rows += [(100, rows[0][1], "en", "src0"), (100, rows[0][1], "en", "src0"), (101, rows[1][1] + " extra", "de", None)]
    rows += [(200, None, "en", "src1"), (201, "", None, "src1"), (None, prose("en", 30, 99), "en", "src0"), (202, "  \n ", "en", None), (203, prose("en", 40_000, 7), "en", "src0")]
    extra = [(*r, len(r[1] or ""), "x", "y", 7, 1.5, True, "t", 3, "g") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, stats string, rule string, keep int, rank double, lang_id boolean, tokens string, piece int, `__kept` string")
