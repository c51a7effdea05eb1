"""Line dedup by winnowing, in DataFrame operations only.

Every window of ``window`` consecutive lines selects the place of its smallest line hash (the rightmost of
equal ones) as a fingerprint, so any two runs of at least ``window`` equal lines share one. Places whose
fingerprint hash is alone in the corpus are done; from the others the match is extended both ways, by
comparing the windows around the fingerprint with the earliest place that has the same lines. Windows that
occur earlier merge into runs, and the later runs are deleted.

Bounded by words too, shorter runs of ``passage`` words or more are windows that select themselves, and so is
the whole of a text with fewer lines than a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.frames import text_key, unused


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def fingerprints(documents: DataFrame, window: int, passage: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, at, hash, first, size, lines): each window with the line that it selected.

    ``place`` orders documents: missing ids last, rows of equal id by a hash of the text. A window is its
    first line, its number of lines and a hash of all of them.
    """
    place = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))
    hashes = F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x))
    rows = documents.select(place.alias("place"), hashes.alias("h"), *([] if passage is None else [F.transform(_lines(F.col(text)), _words).alias("n")]))

    def chosen(first: Column) -> Column:
        lines = F.slice("h", first + 1, window)
        least = F.array_min(F.transform(lines, lambda x, i: F.struct(x.alias("hash"), (-i).alias("back"))))
        return F.struct((first - least["back"]).alias("at"), least["hash"].alias("hash"), first.alias("first"), F.lit(window).alias("size"), F.xxhash64(lines).alias("lines"))

    def firsts(size: int) -> Column:
        return F.when(F.size("h") >= size, F.sequence(F.lit(0), F.size("h") - size)).otherwise(F.array().cast("array<int>"))

    def whole(first: Column, size: int) -> Column:
        lines = F.xxhash64(F.slice("h", first + 1, size))
        return F.struct(first.alias("at"), lines.alias("hash"), first.alias("first"), F.lit(size).alias("size"), lines.alias("lines"))

    def worded(size: int) -> Column:
        def counts(first: Column) -> Column:
            n = F.aggregate(F.slice("n", first + 1, size), F.lit(0), lambda a, x: a + x)
            return (n >= passage) | ((F.size("h") == size) & (n > 0))

        return F.transform(F.filter(firsts(size), counts), lambda first: whole(first, size))

    windows = [F.transform(firsts(window), chosen)] + ([] if passage is None else [worded(k) for k in range(1, window)])
    each = rows.select("place", F.explode(F.concat(*windows)).alias("w"))
    return each.select("place", "w.at", "w.hash", "w.first", "w.size", "w.lines")


def repeated_lines(documents: DataFrame, window: int = 3, passage: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, firsts): first line and size of the windows of each document that occur at an earlier place."""
    found = fingerprints(documents, window, passage, doc_id, text)
    where = F.struct("place", "at")
    counts = found.groupBy("hash").agg(F.min(where).alias("lo"), F.max(where).alias("hi"))
    shared = counts.where("lo <> hi").select("hash")
    near = found.join(shared, "hash", "left_semi")
    spot = F.struct("place", "first")
    earliest = near.groupBy("hash", "lines").agg(F.min(spot).alias("source"), F.max(spot).alias("last")).where("source <> last")
    later = near.join(earliest.select("hash", "lines", "source"), ["hash", "lines"]).where(spot > F.col("source"))
    return later.groupBy("place").agg(F.collect_set(F.struct("first", "size")).alias("firsts"))


def remove_repeated_lines(documents: DataFrame, window: int = 3, doc_id: str = "doc_id", text: str = "text", passage: int | None = None) -> DataFrame:
    """The documents with ``n_lines``, ``n_removed`` and ``kept_text``.

    A line goes if it lies in a run of at least ``window`` lines that also occurs earlier: in a smaller id, or
    further up in the same text. With ``passage``, it also goes if it lies in a shorter run of that many words
    (free of ASCII white space) or more that occurs earlier, or if its text has fewer lines than ``window``, some
    word, and the same lines as all of an earlier text or as such a run of it. Lines end at line feeds and are compared whole. Null and empty texts are one
    empty line; a null id comes last; rows that share id and text are one document; all rows stay, even
    without lines; columns of the three names are replaced, others stay; an empty table gives an empty result.
    """
    base = documents.drop("n_lines", "n_removed", "kept_text")
    place, firsts, lines, kept = unused(base, "place", "firsts", "lines", "kept")
    found = repeated_lines(documents, window, passage, doc_id, text).toDF(place, firsts)
    own = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))
    joined = base.withColumn(place, own).join(found, place, "left").withColumn(lines, _lines(F.col(text)))
    gone = F.array_distinct(F.flatten(F.transform(firsts, lambda s: F.sequence(s["first"], s["first"] + s["size"] - 1))))
    stays = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    out = joined.withColumn(kept, F.when(F.col(firsts).isNull(), F.col(lines)).otherwise(F.transform(stays, lambda i: F.get(F.col(lines), i))))
    size = F.size(lines).cast("long")
    return out.select(*base.columns, size.alias("n_lines"), (size - F.size(kept)).alias("n_removed"), F.array_join(kept, "\n").alias("kept_text"))
