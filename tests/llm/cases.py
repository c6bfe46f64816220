"""Tables with awkward rows, which every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHES = {"fp": "1", "block": "2", "payload": "3", "__text": "4", "score": "5", "ids": "6", "spans": "7", "key": "8", "items": "9", "__row": "10", "bucket": "11", "email": "12", "cleaned": "13", "component_id": "14", "__cell": "15", "__bucket": "16", "longest": "17", "n_hit": "18", "n_words": "19"}


def awkward():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "ßeta", "été", "the", "of", "and", "to"]
    long = " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n"]) for _ in range(40_000))
    prose = " ".join(rng.choice(words) for _ in range(60))
    rows = [
        (0, prose, "en", "a", 1),
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (None, prose, "en", None, 5),
        (None, None, None, None, None),
        (3, prose, "en", "a", 1),
        (3, prose, "en", "a", 1),
        (3, prose + " more", "en", "b", 2),
        (4, long, "de", "a", len(long)),
        (5, long[:70_000] + "X" + long[70_000:], "de", "a", 1),
        (6, " \t\n ", "fr", "a", 4),
        (7, "one", "fr", "a", 3),
        (8, "write to a.b@c.de or +1 (555) 010-2030, card 4111 1111 1111 1111 at 10.0.0.1 now", "en", "a", 1),
        (9, "日本語 テキスト 😀 don't 1st ²x ", "ja", "a", 9),
        (10, "a" * 3000, "en", "a", 3000),
    ]
    return rows


def table(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def texts():
    return [(d, t or "") for d, t, *_ in awkward()]
