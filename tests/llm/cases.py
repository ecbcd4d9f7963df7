"""Small tables with the awkward rows every operator must take."""

import random

WORDS = "the of and river stone light house green walk slowly under bridge morning paper train window garden winter yellow quiet".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use for their own columns.
CLASHING = "n long, node long, _d long, _h string, i int, key string, token string, part string, row string, kept boolean, n_words string, hit_spans string, ids string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", "s", "er", "ing"]) for _ in range(n))


def rows():
    long = " ".join(prose(i, 400) for i in range(40)) + " " + "x" * 30_000 + "\n" * 50
    texts = [None, "", " \n\t ", "one", "two words", prose(1, 30), prose(2, 60) + "\n" + prose(3, 60), long, "日本語 テキスト 😀 <|endoftext|> naïve\x1c\x85 end",
             prose(2, 60) + "\n" + prose(4, 40), prose(1, 30).upper(), "the " * 300, "# * $ % & | < >\n\n#\n#"]
    out = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "a row without an id " + prose(9, 20), "en", None, 1), (None, None, None, None, None)]


def docs(spark, extra=False, some=None):
    given = rows() if some is None else some
    if not extra:
        return spark.createDataFrame(given, DOCS)
    n = len(CLASHING.split(", "))
    return spark.createDataFrame([(*r, *[None] * n) for r in given], f"{DOCS}, {CLASHING}")


def empty(spark):
    return spark.createDataFrame([], DOCS)
