"""Rows and brute-force versions that several tests use."""

import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet " * 20_000


def documents(spark, rows):
    """rows: (doc_id, text) or whole rows."""
    full = [r if len(r) == 5 else (r[0], r[1], "en", "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows."""
    return [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", None, 4),
        (4, LONG, None, "s", len(LONG)),
        (5, "one two three four five six", "en", "s", 27),
        (5, "one two three four five six", "en", "s", 27),
        (None, "one two three four five six", "en", "s", 27),
        (None, None, None, None, None),
        (6, "é", "fr", "s", 1),
    ]


def clashing(df):
    """Extra columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = "n id key row label component kept a b hub size score high low signature features deal pack shard members n_tokens".split()
    return df.select("*", *(F.lit(7).alias(n) for n in names))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text, k):
    words = WORD.findall(lower(text))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def linked(texts, k, percent=80):
    """Smallest id of each id's component, by comparing all pairs that share a shingle."""
    sets = {i: shingle_set(t, k) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = {(a, b) for ids in by_shingle.values() for a in ids for b in ids if a < b}
    for a, b in seen:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}
