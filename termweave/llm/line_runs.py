"""Line dedup by a suffix array over line sequences, built by distributed prefix doubling in DataFrame functions.

Every document is the sequence of its lines that hold a word. A line's name is the place (document, number) where
its text comes first; by doubling, the sequence of h lines from a place gets the first place of an equal sequence as
its name. Places of one name are an interval of the suffix array whose common prefix has at least h lines, so a
place whose name is not itself starts a run that an earlier place holds too. A later copy of a run of ``min_lines`` or
more is a union of such places' windows of ``min_lines``, so doubling stops there: longer names would delete the same
lines. Maximal runs are the stretches that windows cover; of every repeated run the first copy stays and the later
ones are deleted.

A document is known by its id and its text's hash together, so rows that share an id, or have none, are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termweave.llm import shared

HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    """Array of (number, text) of the lines with a word; number counts all lines."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(every, lambda x: x["line"].rlike(HAS_WORD))


def _named(places: DataFrame, keys: list[str], scratch: shared.Scratch, table: str) -> DataFrame:
    """``places`` (doc, own, seq, i, *keys) whose keys occur more than once, with the first place as ``name``.

    Names are counted by partial aggregates before anything moves. They are written, and so stand in the join as a
    table of their own: a key of a third of all rows meets its one name in a join that Spark can split or broadcast.
    """
    names = scratch.keep(places.groupBy(*keys).agg(F.min(F.struct("doc", "own", "seq")).alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), table)
    return places.join(names, keys, "inner").select("doc", "own", "seq", "i", "name")


def _windows(docs: DataFrame, min_lines: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, own, seq) of all windows of ``min_lines`` lines that an earlier place holds too, and i, the first line's number."""
    if min_lines < 1:
        raise ValueError("min_lines must be 1 or more")
    scratch = shared.Scratch(docs.sparkSession, "line-runs")
    data = shared.texts(docs, id_col, text_col).where("text is not null")
    places = data.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("own"), F.posexplode(_lines(F.col("text"))).alias("seq", "x"))
    places = places.select("doc", "own", "seq", F.col("x.i").alias("i"), F.unhex(F.md5("x.line")).alias("key"))
    named = scratch.keep(_named(places, ["key"], scratch, "lines"), "named-1")
    order = W.partitionBy("doc", "own").orderBy("seq")  # a document's own lines only
    span = 1
    while span < min_lines:
        step = min(span, min_lines - span)  # the last step may overlap: equal halves that cover min_lines lines
        ahead = named.withColumn("later", F.first(F.struct("seq", "name")).over(order.rowsBetween(step, step)))
        # rows between here and there may be missing (lines that occur once), so look at the number too
        pairs = ahead.where(F.col("later.seq") == F.col("seq") + step).select("doc", "own", "seq", "i", F.col("name").alias("head"), F.col("later.name").alias("tail"))
        span += step
        named = scratch.keep(_named(pairs, ["head", "tail"], scratch, f"pairs-{span}"), f"named-{span}")
    scratch.only(f"named-{span}")
    return named.where(~F.col("name").eqNullSafe(F.struct("doc", "own", "seq"))).select("doc", "own", "seq", "i")


def repeated_lines(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, own (the text's hash) and the sorted numbers, from 0 over the lines with a word, of those in a later copy of a run."""
    later = _windows(docs, min_lines, id_col, text_col)
    lines = later.select("doc", "own", F.explode(F.sequence(F.col("seq"), F.col("seq") + (min_lines - 1))).alias("seq"))
    return lines.groupBy("doc", "own").agg(F.array_sort(F.collect_set("seq")).alias("gone"))


def maximal_runs(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_line, n_lines of every longest stretch of lines (counted over those with a word) that later copies cover.

    Rows repeated whole share their runs, which are given once.
    """
    later = _windows(docs, min_lines, id_col, text_col).distinct()
    order = W.partitionBy("doc", "own").orderBy("seq")
    new = F.coalesce(F.col("seq") > F.lag("seq").over(order) + min_lines, F.lit(True))
    numbered = later.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    runs = numbered.groupBy("doc", "own", "run").agg(F.min("seq").alias("first_line"), (F.max("seq") - F.min("seq") + min_lines).cast("long").alias("n_lines"))
    return runs.select(F.col("doc").alias("doc_id"), "first_line", "n_lines")


def dedup_lines(docs: DataFrame, min_lines: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, and n_lines and n_removed added.

    A run is ``min_lines`` or more consecutive lines that hold a word; lines of blanks are not compared and stay.
    The first copy by document id (null first; of rows that share an id, by their texts' hash), then line, stays; all
    is judged on the input texts. Exact repeats of a row share a place and are kept alike. A null text stays null with 0
    lines, and a text all of whose lines go becomes empty. Columns of ``docs`` called n_lines or n_removed are replaced.
    """
    gone = repeated_lines(docs, min_lines, id_col, text_col)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    at = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__own"), F.struct(*[docs[c] for c in keep]).alias("__row"))
    both = at.join(gone.hint("merge"), (F.col("__own") == F.col("own")) & F.col("__id").eqNullSafe(F.col("doc")), "left")
    text = F.col("__row")[text_col].cast("string")
    numbered = _lines(text)

    def without(s: Column) -> Column:
        # s is a lambda's variable, so its arrays are made once and not again for every line
        bad = F.transform(s["gone"], lambda k: F.get(s["number"], k))
        left = F.array_except(F.sequence(F.lit(0), F.size(s["every"]) - 1), bad)  # hashed: in proportion to the lines
        return F.array_join(F.transform(left, lambda i: F.get(s["every"], i)), "\n")

    arrays = F.struct(F.split(text, "\n", -1).alias("every"), F.transform(numbered, lambda x: x["i"]).alias("number"), F.col("gone").alias("gone"))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.get(F.transform(F.array(arrays), without), F.lit(0)))
    rest = [kept.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in keep]
    return both.select(*rest, F.coalesce(F.size(numbered), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))


SQL = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM a),
s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, seq, line, lead(line) OVER (PARTITION BY doc_id ORDER BY seq) AS follower FROM s),
r AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY line, follower ORDER BY doc_id, seq) AS copy
      FROM w WHERE follower IS NOT NULL),
g AS (SELECT doc_id, seq FROM r WHERE copy > 1 UNION SELECT doc_id, seq + 1 FROM r WHERE copy > 1),
gone AS (SELECT s.doc_id, s.i FROM s JOIN g ON s.doc_id = g.doc_id AND s.seq = g.seq),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
         FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i WHERE gone.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
d AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(d.n, 0) AS BIGINT) AS n_removed
FROM documents LEFT JOIN kept ON documents.doc_id = kept.doc_id LEFT JOIN n ON documents.doc_id = n.doc_id
LEFT JOIN d ON documents.doc_id = d.doc_id
"""
