"""Small corpora: made-up prose with copies, near copies, shared passages, and odd rows."""

import random

SQL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "ed", "nd", "ou", "ea", "ti", "es", "st", "ing", "ion", "ha"]
    out = []
    while len(out) < n:
        out.append(r.choice(["the", "of", "and", "to"]) if r.random() < 0.3 else "".join(r.choices(syllables, k=r.randint(2, 4))))
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in out)


def rows() -> list[tuple]:
    """Doc 0-59; 60-69 copies of 0; 70-79 near copies of 1; 80-89 share a passage; the rest are odd."""
    shared = prose(999, 120)
    out = [(i, prose(i, 40 + 17 * i), ["en", "de"][i % 2], f"src{i % 3}") for i in range(60)]
    out += [(60 + i, out[30][1], "en", "src0") for i in range(10)]
    for i in range(10):
        w = prose(31, 40 + 17 * 31).split()
        w[50 + 20 * i] = f"changed{i}"
        out.append((70 + i, " ".join(w), "en", "src0"))
    out += [(80 + i, f"{prose(500 + i, 60)} {shared} {prose(600 + i, 30)}", "en", "src1") for i in range(10)]
    out += [(90, None, "en", "src0"), (91, "", None, None), (92, " \n\t ", "en", "src1"), (93, "one", "en", None), (94, "one two three four", "fr", "src2"), (95, "tick " * 900, "en", "src2"), (96, "aé" * 3000, "fr", "src2")]
    out += [(97, prose(97, 20_000), "en", "src2"), (98, prose(98, 300), "en", "src0"), (98, prose(98, 300), "en", "src0"), (None, prose(3, 40 + 17 * 3), "en", "src1")]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in out]


def frame(spark, some=None):
    """The corpus, dealt over a few partitions, with extra columns whose names helpers might use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows() if some is None else some, SQL).repartition(3)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(("key", "dig", "h", "row", "of", "node", "ranges", "rows", "q_text", "size", "first"))})


def empty(spark):
    return spark.createDataFrame([], SQL)
