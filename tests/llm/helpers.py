"""Brute-force statements of the contracts, and odd inputs."""

import hashlib
import re

from pyspark.sql import functions as F

WORD = re.compile("[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows):
    """(doc_id, text) with other columns, some of names that operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("words", F.lit("clash")).withColumn("component", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))


LONG = " ".join(f"w{i * i % 997}" for i in range(6000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "One two three"), (7, LONG), (8, LONG + " tail"),
    (9, "a b c d e f g h i j k l m n o p"), (10, "a b c d e f g h i j k l m n o q"), (None, "no id here at all"), (12, "same same same same same same"),
    (13, "é ü z\x00 \x1f end"), (14, "x" * 5000),
]


def near_groups(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = [x.translate(LOWER) for x in words(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def cut_windows(rows, window=50):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            owner[key] = min(owner.get(key, d), d)
    out = {}
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if owner[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
