"""Small frames with the awkward cases, and plain versions of shared definitions."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall(text or "")


def shingles(text, k):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def documents(spark, texts, lang="en", source="s"):
    """One row a text, numbered from 1."""
    return frame(spark, [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts, 1)])


def prose(seed, n, size=400):
    """``n`` words of an invented vocabulary, the same for a seed."""
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size):x}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def component_of(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
