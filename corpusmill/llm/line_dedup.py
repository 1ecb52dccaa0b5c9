"""Line dedup: lines that several documents share stay in one of them only.

1. Every text is exploded into its lines, with their positions. A line's key (ends stripped, A-Z lower-cased) is hashed if it is
   long enough; from here on 16 bytes of its SHA-256 stand for it, so what is shuffled does not grow with a line's length.
2. Distinct documents are counted per hash, and the largest is found. Pairs of hash and document are made distinct first, dealt
   by both, so that a line which a third of all documents hold is spread over all tasks; its counts are then summed.
3. Lines whose hash is over the threshold give their document's dropped positions. Few such hashes (counted) are broadcast; of
   many, the hottest are, and the rest is joined by a shuffle.
4. The positions that are left are put together again, in order, in the row of the text. Texts move once, and only to
   meet their dropped positions; a text without any is passed on as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import HOT, join_spread, kept, text_rows

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3


def lines_of(text: Column) -> Column:
    """The parts between line feeds; an empty text is one empty line."""
    return F.split(text, "\n")


def key_of(bare: Column) -> Column:
    """A line that is stripped already, with A-Z lower-cased and all other letters as they are."""
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(rows: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, mark, at, hash) of the lines of rows (doc_id, mark, text) that are long enough: their place in the text and the hash of their key."""
    lines = rows.select("doc_id", "mark", F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    long = lines.select("doc_id", "mark", "at", F.btrim("line", F.lit(BLANK)).alias("bare")).where(F.char_length("bare") >= least_chars)
    return long.select("doc_id", "mark", "at", F.unhex(F.substring(F.sha2(key_of(F.col("bare")), 256), 1, 32)).alias("hash"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(hash, keep_id, times) of the lines that at least ``least_docs`` documents hold: the largest of these, and their number."""
    null = F.max(F.col("doc_id").isNull().cast("int"))
    counted = lines.groupBy("hash").agg((F.count_distinct("doc_id") + null).alias("times"), F.max("doc_id").alias("keep_id"))
    return counted.where(F.col("times") >= least_docs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, text (without the dropped lines), n_lines (before dropping) and n_dropped of every row.

    A key of at least ``least_chars`` code points that at least ``least_docs`` documents hold loses all its lines but those of the
    largest doc_id that holds it; repeats within one document count once and go or stay together. Null and empty texts are one
    empty line. Rows that repeat a doc_id are one document and each give a row; all rows with a null doc_id are
    one document, below every other. Where every line goes, the text is empty. Extra columns are not read; an empty table
    gives no rows.
    """
    rows = text_rows(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))  # rows of one doc_id are told apart by their text
    lines = kept(hashed_lines(rows, least_chars), "line-hashes")
    shared = kept(shared_lines(lines, least_docs), "shared-lines")
    total = shared.agg(F.sum("times")).first()[0] or 0
    hot = shared.where(F.col("times") > max(HOT, total // 4096)).select("hash")  # so 4096 hashes at most
    over = join_spread(lines, shared, "hash", None if hot.isEmpty() else hot)
    gone = over.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("gone"))
    gone = gone.withColumnsRenamed({"doc_id": "__id", "mark": "__mark"})
    met = rows.join(gone, rows["doc_id"].eqNullSafe(gone["__id"]) & (rows["mark"] == gone["__mark"]), "left")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    split = met.select("doc_id", "text", "gone", n_gone.cast("long").alias("n_dropped"), lines_of(F.col("text")).alias("lines"))
    n = F.size("lines")
    left = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), F.col("gone")), lambda at: F.get(F.col("lines"), at))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join(left, "\n"))
    return split.select("doc_id", text.alias("text"), n.cast("long").alias("n_lines"), "n_dropped")
