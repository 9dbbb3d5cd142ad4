"""The registered queries of the operators, with their production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bagminhash, compression, hardneg, language, nearest, packing, periodic, piece, pii, recompression, separators, simhash,
               toxicity)
from .base import crc_fold, table, text_slices, texts_of


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_files() -> dict:
    import public_tokenizers

    return {"json_path": tokenizer_path("byte_bpe_50k.json"), "ranks_path": tokenizer_path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents", *(columns or ("doc_id", "text")))


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.find(docs, pii.fit_field(docs))


def op2_compression(spark: SparkSession, folder: str) -> DataFrame:
    return compression.quality(documents(spark, folder))


def op3_piece(spark: SparkSession, folder: str) -> DataFrame:
    return piece.encoding_digests(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, "doc_id", "text", "lang")
    fold = crc_fold(F.col("doc_id"), 4)
    found = language.identify(docs, language.fit(docs.where(fold != 2)))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


def op5_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.dedup(documents(spark, folder))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return separators.document_counts(documents(spark, folder), **bpe_files(), eod=50256)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, fold = documents(spark, folder), crc_fold(F.col("doc_id"), 3)
    labels = (table(spark, folder, "labels", "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    scored = toxicity.score(docs, labels.where(fold != 1).select("doc_id", "toxic", (fold == 2).cast("int").alias("fold")))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), **bpe_files())


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.classes(documents(spark, folder)).select("doc_id", "class_id", "n_copies")


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(table(spark, folder, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.components(documents(spark, folder))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    # A seventh of the rows carry a wrong label, so that negatives above and below the positives exist in every class.
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", wrong), F.col("vec_id") % 100 == 0)


def looped_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document's words repeat from some word on, as the query's contract fixes it; without a doc_id nothing changes."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def with_looped_tails(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in text_slices(batches):
            texts = [b" ".join(looped_tail(t.encode().split(), d)).decode() for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.find(with_looped_tails(documents(spark, folder))))


QUERIES = {f.__name__: f for f in (op1_pii, op2_compression, op3_piece, op4_language, op5_substrings, op6_token_counts, op7_toxicity,
                                   op8_packing, op9_near_duplicates, op10_nearest, op11_simhash, op12_hard_negatives, op13_periodic)}
ORACLES: dict[str, str] = {
    # Words with a space after each, whole windows by slices; the smallest doc_id of every window decides.
    "op5_substrings": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
     g AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS k
           FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
     late AS (SELECT g.doc_id, g.i FROM g JOIN (SELECT k, min(doc_id) AS least FROM g GROUP BY k) USING (k) WHERE g.doc_id > least),
     gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM late) GROUP BY doc_id),
     kept AS (SELECT w.doc_id, len(words) AS n, CASE WHEN ps IS NULL THEN words ELSE
                     list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda z: NOT list_contains(ps, z[2])), lambda z: z[1]) END AS kw
              FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, n - len(kw) AS n_removed, sha256(array_to_string(kw, ' ')) AS kept_sha256 FROM kept""",
    # Every anchor against every row; positives, then the window below each.
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
           FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""",
}
