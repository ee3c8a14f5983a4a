"""Line dedup by range-partitioned line hashes; DataFrame functions only.

Every line of at least `least_chars` key code points becomes a row (128-bit hash of its key,
document, position).  Rows are dealt to ranges of the hash: the hash space is cut into 65,536 equal
cells, a histogram of the cells lays ranges of about equal row counts over them, and a cell that
alone exceeds a range (a line that very many documents hold) is dealt to several ranges by
document.  A range is sorted by hash, document (largest first) and position, and one streaming pass
numbers the documents of each hash: its first occurrences are those of document 1.  A hash whose
cell was split gets one total of its ranges.  What goes back to a document is no text but its keep
bitmap, run-length compressed: the runs (start, length) of the lines that stay.

Documents are told apart by doc_id and text, so rows that are copies in both count as one and get
the same bitmap; different texts under one doc_id are two documents.  A null doc_id is smaller than
all others.  A null or empty text is one empty line.  Lines equal in key within the document that
keeps them all stay.  An empty table gives no rows.  Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sublens.llm.common import written

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CELL_DIGITS = 4  # hexadecimal digits of a hash that name its cell; 65,536 cells bound the histogram


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_id"), text.alias("text"))


def _occurrences(texts: DataFrame, least_chars: int) -> DataFrame:
    lines = texts.select("doc_id", "text_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long = lines.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= least_chars)
    return long.select(F.md5(line_key(F.col("line"))).alias("hex"), "doc_id", "text_id", "pos").select(
        F.substring("hex", 1, CELL_DIGITS).alias("cell"), F.unhex("hex").alias("hash"), "doc_id", "text_id", "pos")


def _ranges(found: DataFrame, ranges: int) -> DataFrame:
    """(cell, first, parts): cells in order share ranges up to the mean number of rows; a cell of
    more rows than that gets `parts` ranges.  At most 16^CELL_DIGITS rows, so one task and a
    broadcast hold them whatever the input."""
    cells = found.groupBy("cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    target = F.greatest(F.lit(1), F.ceil(F.sum("rows").over(Window.partitionBy()) / ranges))
    return cells.select("cell", "rows", F.coalesce(before, F.lit(0)).alias("before"), target.alias("target")).select(
        "cell", F.floor(F.col("before") / F.col("target")).cast("int").alias("first"), F.ceil(F.col("rows") / F.col("target")).cast("int").alias("parts"))


def dropped_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, ranges: int | None = None) -> DataFrame:
    """(doc_id, text_id, pos) of every line that goes.  `ranges` (default: the session's number of
    shuffle partitions) is cost only."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = _occurrences(_texts(docs), least_chars)
    cells = F.broadcast(_ranges(found, ranges))
    dealt = found.join(cells, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("doc_id", "text_id"), F.col("parts"))).cast("int").alias("range"),
        (F.col("parts") > 1).alias("split"), "hash", "doc_id", "text_id", "pos").repartitionById(ranges + 1, "range")
    group = Window.partitionBy("range", "hash")
    order = group.orderBy(F.col("doc_id").desc_nulls_last(), "text_id", "pos")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    document = F.struct("doc_id", "text_id")
    numbered = dealt.select("*", F.row_number().over(order).alias("place"), F.first("doc_id").over(whole).alias("keeper"),
                            (~F.lag(document).over(order).eqNullSafe(document)).cast("int").alias("new")).select(
        "*", F.sum("new").over(whole).alias("documents"))
    other = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    # Lines that go for certain, and all of split cells, whose totals are still to come.
    kept = written(numbered.where(F.col("split") | ((F.col("documents") >= least_docs) & other)).drop("new"), "repeated-lines")
    # A split hash is one row per range in its total, and its lines meet the total range by range.
    every_range = Window.partitionBy("hash")
    totals = kept.where("split and place = 1").select("range", "hash", F.sum("documents").over(every_range).alias("documents"), F.max("keeper").over(every_range).alias("keeper"))
    split = kept.where("split").drop("documents", "keeper").join(totals.where(F.col("documents") >= least_docs), ["range", "hash"]).where(other)
    return kept.where("not split").select("doc_id", "text_id", "pos").unionAll(split.select("doc_id", "text_id", "pos"))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, ranges: int | None = None) -> DataFrame:
    """(doc_id, text_id, n_dropped, keep) of the documents that lose lines; `keep` holds the runs
    struct<start, length> of lines that stay, `length` -1 for all lines to the end."""
    gone = F.sort_array(F.collect_set("pos"))
    after = F.concat(F.array(F.lit(-1)), "gone")
    length = F.concat(F.col("gone"), F.array(F.lit(None).cast("int")))
    runs = F.filter(F.zip_with(after, length, lambda a, b: F.struct((a + 1).alias("start"), F.coalesce(b - a - 1, F.lit(-1)).alias("length"))), lambda r: r["length"] != 0)
    return dropped_lines(docs, least_chars, least_docs, ranges).groupBy("doc_id", "text_id").agg(gone.alias("gone")).select(
        "doc_id", "text_id", F.size("gone").cast("long").alias("n_dropped"), runs.alias("keep"))


def kept_text(lines: Column, keep: Column) -> Column:
    """The lines of the runs in `keep`, joined by line feeds; a null `keep` keeps all."""
    pieces = F.transform(keep, lambda r: F.slice(lines, r["start"] + 1, F.when(r["length"] < 0, F.size(lines)).otherwise(r["length"])))
    return F.array_join(F.when(keep.isNull(), lines).otherwise(F.flatten(pieces)), "\n")


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, ranges: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, n_lines, n_dropped, keep (null: all) and the kept text."""
    gone = keep_bitmaps(docs, least_chars, least_docs, ranges).alias("gone")
    texts = _texts(docs).alias("all")
    rows = texts.join(gone, F.col("all.doc_id").eqNullSafe(F.col("gone.doc_id")) & (F.col("all.text_id") == F.col("gone.text_id")), "left")
    lines = F.split("text", "\n")
    return rows.select("all.doc_id", "text", lines.alias("lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep").select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), "n_dropped", "keep", kept_text(F.col("lines"), F.col("keep")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
          FROM (SELECT DISTINCT doc_id, text FROM t)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT (doc_id, text)) >= 5),
marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key),
per_doc AS (SELECT doc_id, text, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
                   sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
            FROM marked GROUP BY doc_id, text)
SELECT t.doc_id, p.n_lines, p.n_dropped, p.kept_sha256
FROM t JOIN per_doc p ON t.doc_id IS NOT DISTINCT FROM p.doc_id AND t.text = p.text
"""
