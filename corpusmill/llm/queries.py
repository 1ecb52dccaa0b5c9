"""The queries op1 to op13 with production parameters, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, html_extract, line_dedup, merkle, packing, quality, schema_rewrite, secrets, sentencepiece_codec, simhash, spelling, token_file, toxicity
from corpusmill.llm.bpe import byte_bpe, word_bpe
from corpusmill.llm.common import table

CAPACITY, END_PACK, END_FILE = 2048, 0, 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ready(spark: SparkSession) -> None:
    """Lets Python workers that share this machine import the package from where the driver has it, and keeps their batches small, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = str(Path(__file__).resolve().parents[2])
    seen = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in seen:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, seen)])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), partial(byte_bpe, path), CAPACITY, END_PACK)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("word_bpe_49k.json")
    return token_file.read_tokens(token_file.write_tokens(table(spark, sf_dir, "documents"), partial(word_bpe, path), token_file.new_folder(spark), END_FILE))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.train())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_with_edits(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return told.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_rewrite.rewrite_clients(table(spark, sf_dir, "clients"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def run(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return f(spark, sf_dir)

        return query

    found = (op1_exact_dedup, op2_best_fit_packing, op3_secret_scan, op4_token_file, op5_quality, op6_html_extraction, op7_toxicity, op8_simhash, op9_sentencepiece, op10_fingerprints, op11_line_dedup, op12_spelling_variants, op13_schema_rewrite)
    return {f.__name__: run(f) for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)""",
        "op11_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, pos, line, s.key IS NOT NULL AND doc_id <> keep_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
        "op12_spelling_variants": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
coded AS (SELECT w, n, hex(encode(doc_id || ':' || w)) AS x FROM low),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM coded, crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.part = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.part = b.word),
best AS (SELECT word, count(*)::BIGINT AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word),
told AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
steps(word, upto) AS (SELECT word, word FROM told UNION ALL SELECT s.word, t.form FROM steps s JOIN told t ON s.upto = t.word WHERE t.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN (SELECT s.word, s.upto AS root FROM steps s JOIN told t ON s.upto = t.word WHERE t.form IS NULL) USING (word)""",
    }
