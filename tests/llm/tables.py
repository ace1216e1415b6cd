"""Small tables with every odd row."""

import random

#: Names that operators use inside, and the types of the columns that bear them here.
CLASHES = "lang string, source string, n_chars long, size long, key string, range int, part string, shard string, slot string, rank int, bucket string, start string, taken string, block string, node string, th string, bands string, comp string, label string, score string, spans string, kept string, media string, word string, n_words string, doc string, value string"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" + r.choice(["", "", ".", ","]) for _ in range(n))


def corpus(seed=3, n=40):
    """Rows (doc_id, text) with null, empty, short, equal, near-equal and very long texts and repeated rows."""
    r = random.Random(seed)
    base = [words(r, r.randrange(5, 120)) for _ in range(n)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "!!! ???"), (104, "one"), (105, "a b c d"), (106, "a b c d"), (107, "äöü 日本 \U0001f600 x\x00y  z"), (108, None), (109, "")]
    rows += [(200 + i, base[i]) for i in range(6)]
    rows += [(300 + i, base[7] + " tail" * i) for i in range(4)]
    rows += [(400, words(r, 6000)), (401, "x" * 100_000), (402, "again " * 3000)]
    rows += [(2, base[2]), (2, base[2]), (3, words(r, 30)), (None, base[5]), (None, None)]
    return rows


def frame(spark, rows, extra=False):
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    n = len(CLASHES.split(","))
    sources = ["a", "b", None, "c"]
    return spark.createDataFrame([(i, t, None, sources[k % 4], *[None] * (n - 2)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, {CLASHES}")
