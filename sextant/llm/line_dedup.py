"""Line deduplication: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, by_place, checkpointed, with_names

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    key = F.btrim(line, F.lit(BLANKS))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, upper, lower))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _without_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` by place with ``text`` and what is left of it: ``n_lines``, ``n_dropped``, ``kept``.

    Lines travel as two 64-bit hashes with their document and position, never as
    text. The count per hash combines on the map side, so a line in a third of all
    documents makes no large group. The common hashes are written out before they
    are joined back to their rows: both sides are then plain exchanges, whose skewed
    keys adaptive execution splits.
    """
    doc, text = F.col("doc_id"), F.col("text").cast("string")
    read = docs.select(doc.alias("doc"), F.xxhash64(text).alias("same"), F.posexplode(F.transform(_lines(text), line_key)).alias("at", "key"))
    lines = read.where(F.col("doc").isNotNull() & (F.length("key") >= min_chars)).select(
        "doc", "same", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    )
    if min_docs == 2:
        common = lines.groupBy("h1", "h2").agg(F.min("doc").alias("keeper"), F.max("doc").alias("last")).where("keeper <> last")
    else:
        each = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        common = each.groupBy("h1", "h2").agg(F.min("doc").alias("keeper"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    gone = (
        lines.join(checkpointed(common.select("h1", "h2", "keeper")), ["h1", "h2"])
        .where("doc <> keeper")
        .groupBy("doc", "same")
        .agg(F.collect_set("at").alias("gone"))
    )
    named = by_place(docs, in_doc=doc, text=text).withColumn("in_same", F.xxhash64("text"))
    joined = named.join(gone, (F.col("in_doc") == F.col("doc")) & (F.col("in_same") == F.col("same")), "left")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.transform(F.array_except(every, F.col("gone")), lambda i: F.get(F.col("lines"), i))
    return (
        joined.withColumn("lines", _lines(F.col("text")))
        .withColumn("n_lines", F.size("lines").cast("long"))
        .withColumn("n_dropped", F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long"))
        .withColumn("kept", F.when(F.col("n_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.coalesce("text", F.lit(""))))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped`` and ``kept_text``, which replace columns of these names.

    A null or empty text is one empty line. Lines whose key has ``min_chars``
    code points or more and is in at least ``min_docs`` documents go, except in the
    smallest ``doc_id`` that holds it; a document's own repeats count once. Rows
    without a ``doc_id`` neither count nor lose a line. Rows that share a
    ``doc_id`` are one document. Other columns pass through, whatever they are named;
    no rows give none.
    """
    out = _without_common_lines(docs, min_chars, min_docs)
    return with_names(out, docs.columns, n_lines=F.col("n_lines"), n_dropped=F.col("n_dropped"), kept_text=F.col("kept"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, and ``n_chars`` in step with it.

    Null texts stay null; documents that lose every line stay with an empty text. All
    other columns pass through as they are, whatever they are named.
    """
    out, values = _without_common_lines(docs), []
    changed = F.col("n_dropped") > 0
    for i, (name, kind) in enumerate(docs.dtypes):
        value = F.col(f"c{i}")
        if name.lower() == "text":
            value = F.when(changed, F.col("kept")).otherwise(value)
        elif name.lower() == "n_chars":
            value = F.when(changed, F.length("kept").cast(kind)).otherwise(value)
        values.append(value)
    return out.select(*values).toDF(*docs.columns)


def line_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` of every row of ``docs``."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, line_no, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line_no, k.line, (c.key IS NOT NULL AND k.doc_id <> c.keeper) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
