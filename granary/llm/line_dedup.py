"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

A text is cut into chunks of consecutive lines at places that its content chooses: each line has a hash, a
rolling hash runs over the hashes of a line and the one before it, and a chunk ends after a line whose rolling
hash is a strict local minimum. Such places depend on four lines only, so an insertion elsewhere
doesn't shift them, and such a cut is at least two lines from the next.

A boundary within a shared passage needs four of its lines, so chunks alone miss passages of few, long lines. Therefore the pieces of a text that
are compared are its chunks of two lines or more and its runs: from each line on, the fewest lines that have more than ``WORDS`` words together
(``RUN_LINES`` lines at most; a word is ``[^\\x20\\x09-\\x0D]+``).

Pieces whose hash occurs more than once are compared byte by byte (grouped by their very text);
of equal pieces the first, by document id and place, stays, and the lines of the others go with their line breaks, unless they overlap the
first one. So each line that goes stands in an equal piece before, and no passage is lost from all documents. Single lines of no more words are never
removed. Only numbers shuffle for all lines; texts do for documents that hold a piece with a repeated hash.

Edge cases: a null text stays null and has no piece; an empty text is one line. A text that is
removed as a whole becomes empty; its row stays. Rows that agree in id and text count as one document: they
get the same text. Null ids come last in the order, then texts go by their digest. Other columns of the input are kept as they are, whatever their names. Empty
tables give empty results. A text of very many lines costs as much as its lines, for each line a few array steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import broadcast_small, marked, materialize, packed, text_digest

#: Modulus and base of the rolling hash; line hashes are the first 32 bits of an MD5.
PRIME, BASE = 2147483647, 31
#: Words that a run of lines has more of, and a power of two, the lines that it has at most.
WORDS, RUN_LINES = 50, 64
#: A word, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def _shifted(name: str, by: int, pad) -> Column:
    """The array without its first ``by`` entries, filled up at the end."""
    return F.slice(F.concat(F.col(name), F.array_repeat(F.lit(pad), by)), F.lit(by + 1), F.size(F.col(name)))


def _code(at: Column, lines: Column) -> Column:
    """A place as one long: where it begins, and how many lines it has."""
    return at.cast("bigint") * (1 << 32) + lines.cast("bigint")


def place_of(code: Column) -> tuple[Column, Column]:
    return F.shiftright(code, 32).cast("int"), code.bitwiseAND((1 << 32) - 1).cast("int")


def _longer(k: int):
    """Lengthens a run by 2 ** k lines if it has no more words than ``WORDS`` then."""

    def step(run: Column) -> Column:
        words = run["words"] + F.coalesce(F.get(f"words{k}", run["at"] + run["more"]), F.lit(0))
        longer = F.struct(run["at"].alias("at"), (run["more"] + (1 << k)).alias("more"), words.alias("words"))
        return F.when(words <= WORDS, longer).otherwise(run)

    return step


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def pieces_of(texts: DataFrame) -> DataFrame:
    """(id, digest, code, hash) of rows (id, digest, text): the pieces of each text. One projection for each step, so that none is evaluated twice."""
    before = lambda name, first: F.slice(F.concat(F.array(F.lit(first).cast("bigint")), F.col(name)), F.lit(1), F.size(name))
    line_hash = lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 8), 16, 10).cast("bigint")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    steps = {
        "lines": lines_of(F.col("text")),
        "hashes": F.transform("lines", line_hash),
        "rolled": F.zip_with(before("hashes", 0), "hashes", lambda p, h: F.pmod(F.pmod(p, F.lit(PRIME)) * BASE + h, F.lit(PRIME))),
        "falls": F.zip_with(before("rolled", PRIME), "rolled", lambda p, r: F.when(r < p, r)),
        "cuts": F.zip_with("falls", _shifted("rolled", 1, -1), lambda r, n: F.coalesce(r < n, F.lit(False))),
        "begins": F.filter(every, lambda i: (i == 0) | F.coalesce(F.get("cuts", i - 1), F.lit(False))),
        "chunks": F.zip_with("begins", F.slice(F.concat("begins", F.array(F.size("lines"))), F.lit(2), F.size("begins")), lambda a, b: _code(a, b - a)),
        "words0": F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))),
    }
    depth = RUN_LINES.bit_length() - 1
    for k in range(1, depth):  # words of 2, 4, 8, ... lines
        steps[f"words{k}"] = F.zip_with(f"words{k - 1}", _shifted(f"words{k - 1}", 1 << (k - 1), 0), lambda a, b: a + b)
    steps["runs"] = F.transform(every, lambda i: F.struct(i.alias("at"), F.lit(0).alias("more"), F.lit(0).alias("words")))
    for k in reversed(range(depth)):  # as many lines as have no more words than a run needs
        steps[f"runs{k}"] = F.transform("runs" if k == depth - 1 else f"runs{k + 1}", _longer(k))
    steps["whole"] = F.filter("runs0", lambda r: r["words"] + F.coalesce(F.get("words0", r["at"] + r["more"]), F.lit(0)) > WORDS)
    steps["codes"] = F.array_union(F.filter("chunks", lambda c: c.bitwiseAND((1 << 32) - 1) > 1), F.transform("whole", lambda r: _code(r["at"], r["more"] + 1)))
    steps["pieces"] = F.transform("codes", lambda c: F.struct(c.alias("code"), F.xxhash64(F.slice("lines", place_of(c)[0] + 1, place_of(c)[1])).alias("hash")))
    for name, step in steps.items():
        texts = texts.withColumn(name, step)
    # The outer form: the other one gets a filter on the array's size, which would evaluate every step again.
    return texts.select("id", "digest", F.inline_outer("pieces")).where("hash IS NOT NULL")


def redundant_pieces(rows: DataFrame) -> DataFrame:
    """(key_id, key_digest, gone): the places of pieces, in rows of (doc_id, digest, text), that an earlier equal piece makes redundant."""
    pieces = materialize(pieces_of(rows.where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "digest", "text")), "line-pieces")
    hashes = materialize(pieces.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hash").alias("shared")), "line-hashes")
    maybe = pieces.join(broadcast_small(hashes), F.col("hash") == F.col("shared"), "left_semi")
    maybe = materialize(maybe.groupBy(F.col("id").alias("key_id"), F.col("digest").alias("key_digest")).agg(F.collect_set("code").alias("codes")), "line-maybe")

    found = marked(rows.where("text IS NOT NULL").select("doc_id", "digest", "text"), maybe, "codes").where("codes IS NOT NULL").withColumn("lines", lines_of(F.col("text")))
    spelt = F.transform("codes", lambda c: F.struct(c.alias("code"), F.array_join(F.slice("lines", place_of(c)[0] + 1, place_of(c)[1]), "\n").alias("piece")))
    spelt = found.withColumn("spelt", spelt).select(F.col("doc_id").alias("id"), "digest", F.inline_outer("spelt"))
    at, lines = place_of(F.col("code"))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", at.alias("at"), lines.alias("lines"))
    compared = materialize(spelt.select("id", "digest", "code", "piece", F.xxhash64("piece").alias("hash")), "line-compared")
    first = compared.groupBy("hash", "piece").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select(F.col("hash").alias("h"), F.col("piece").alias("p"), "first"), "line-first")
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    apart = other | (F.col("first.at") + F.col("first.lines") <= at)
    gone = compared.join(first, (F.col("hash") == F.col("h")) & (F.col("piece") == F.col("p"))).where(apart)
    return gone.groupBy(F.col("id").alias("key_id"), F.col("digest").alias("key_digest")).agg(F.collect_set("code").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with the repeated pieces taken out of their texts; with ``removed_col``, also how many lines each row lost."""
    text = F.col(f"`{text_col}`")
    gone = materialize(redundant_pieces(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(text).alias("digest"), text.alias("text"))), "line-gone")
    rows = marked(packed(docs, id_col, text_col), gone, "gone")
    changed = rows.withColumn("lines", F.when(F.col("gone").isNotNull(), lines_of(F.col("row").getField(text_col))))
    covered = F.flatten(F.transform("gone", lambda c: F.sequence(place_of(c)[0], place_of(c)[0] + place_of(c)[1] - 1)))
    changed = changed.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered))
    rest = F.when(F.col("gone").isNull(), F.col("row").getField(text_col)).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    columns = [rest.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return changed.select(*columns, *([removed.cast("long").alias(removed_col)] if removed_col else []))
