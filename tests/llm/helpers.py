"""Small documents and plain Python versions of what the operators compute."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs_of(spark, texts, ids=None, lang=None):
    """Documents with the given texts and the ids 0, 1, ... or ``ids``."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang[k] if lang else "en", "src", len(t) if t is not None else None) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


#: Texts that have broken things before.
ODD = [None, "", " \t\n", "\n\n\n", "a", "é", "😀 ok", "A\x00b", "  lead", "trail  ", "x" * 5000, "word " * 3000, "<|endoftext|>", "it's so new", "ÀÉ ñandú", "a\r\nb\x0bc\x0cd"]


def words(text):
    return (text or "").encode().lower().split()


def components(nodes, linked):
    """Least reachable node of each, by union and find over all pairs."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def simhash(text, n):
    import xxhash

    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def pieces(text):
    """(place, lines) of content-defined chunks of two lines or more, and of the shortest runs of over 50 words, line by line."""
    import hashlib

    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    p = 2147483647
    rolled = [((h[i - 1] if i else 0) % p * 31 + h[i]) % p for i in range(len(h))]
    out, begin = set(), 0
    for i in range(len(lines)):
        before = rolled[i - 1] if i else p
        after = rolled[i + 1] if i + 1 < len(rolled) else -1
        if rolled[i] < before and rolled[i] < after or i + 1 == len(lines):
            out.add((begin, i + 1 - begin))
            begin = i + 1
    out = {(at, n) for at, n in out if n > 1}
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
    for i in range(len(lines)):
        total = 0
        for j in range(i, min(len(lines), i + 64)):
            total += count[j]
            if total > 50:
                out.add((i, j + 1 - i))
                break
    return sorted(out)


def line_dedup(rows):
    """{id: text} of rows (id, text) with different ids, without redundant pieces."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if text is None:
            out[i] = None
            continue
        lines, gone = text.split("\n"), set()
        for at, n in pieces(text):
            doc, end = first.setdefault("\n".join(lines[at : at + n]), (i, at + n))
            if doc != i or end <= at:
                gone |= set(range(at, at + n))
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def shingle_set(text, n=5):
    w = words(text)
    return frozenset(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([b" ".join(w)])


def near_groups(texts, similarity=0.8):
    """{id: least id of its group} by the similarity of all pairs that share a shingle."""
    sets = {i: shingle_set(t) for i, t in texts.items()}
    alike = lambda a, b: bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    return components(sorted(sets), alike)
