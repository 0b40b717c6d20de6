"""Frames that every corpus operator must survive."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, row string, uid bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = "an er the in re on at en nd ti es or".split()
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return "".join(w + (".\n" if i % 17 == 16 else " ") for i, w in enumerate(words))


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and columns with clashing names."""
    same = prose(7, 60)
    rows = [
        (None, None, None, None, None, None, None, None),
        (1, "", "en", "a", 0, True, "x", 5),
        (1, "", "en", "a", 0, True, "x", 5),
        (2, " \n\t ", None, "b/c/d", 3, False, None, 5),
        (3, same, "en", "a", len(same), None, "y", None),
        (3, same, "en", "a", len(same), None, "y", None),
        (4, same, None, None, None, None, "y", None),
        (None, same, "en", "https://h.org/p/q", None, None, None, 1),
        (5, prose(8, 40_000), "en", "a", None, None, None, 1),
        (6, "x" * 200_000, "xx", "a", None, None, None, 1),
        (7, "naïve ÅNGSTRÖM 你好 世界 \U0001f600 ok <|endoftext|> don't\xa0stop now é 5,000 ½", "de", "a", None, None, None, 1),
        (8, "a@b.c " + "1.2.3.4 " + "+1 (555) 555-0100 " + "4111 1111 1111 1111", "en", "a", None, None, None, 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
