"""Small documents that meet the awkward cases: nulls, empty and long texts, ties, repeats."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size string"
WORDS = ("the of and to in that is was for on with as by at from this have or one had not but "
         "what all were when we there can an your which their said if do will each about how "
         "Ünder café naïve straße éclair").split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(extra: list[tuple] = ()) -> list[tuple]:
    """(doc_id, text): awkward rows first."""
    base = [(0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, "One"), (5, prose(5, 4000)),
            (6, prose(6, 60)), (7, prose(6, 60)), (7, prose(6, 60)), (8, prose(6, 60).upper()),
            (None, prose(9, 30)), (10, "a\n\nb\r\nc  d <|endoftext|> e "), (11, "日本 語 😀 x y")]
    return base + list(extra)


def frame(spark, pairs, with_extra: bool = True):
    full = [(d, t, "en", None, len(t or ""), 1, "x") for d, t in pairs]
    df = spark.createDataFrame(full, SCHEMA)
    return df if with_extra else df.select("doc_id", "text")
