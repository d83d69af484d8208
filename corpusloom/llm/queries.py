"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, fingerprints, langid, mixing, neighbours, packing, rank_bpe, simhash, store, substrings, token_counts, token_files, warc, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_dir(spark, "token-files")
    token_files.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), "lower", end_id=1)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(_read(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.without_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"), shingle=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_dir(spark, "warc")
    archives = warc.write_archives(_read(spark, sf_dir, "pages"), f"{path}/monolithic")
    warc.normalise(archives, f"{path}/members")
    return warc.read_records(spark, f"{path}/members").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_dir(spark, "packed")
    packing.write_buckets(packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "bytes", end_id=0), path)
    return packing.read_buckets(spark, path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)
    model = langid.train(docs.where("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = rank_bpe.encode(_read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    decoded = rank_bpe.decode(tokens, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(rank_bpe.decimal_text("ids"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_neighbours, op3_fingerprints, op4_substrings, op5_simhash, op6_token_counts, op7_mixing, op8_warc, op9_packing, op10_langid, op11_rank_bpe, op12_alignment, op13_whitening)}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_substrings": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        win AS (
            SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS words
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        many AS (SELECT words FROM win GROUP BY words HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM win WHERE words IN (SELECT words FROM many)),
        each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        marked AS (SELECT e.doc_id, e.i, e.word, g.i IS NOT NULL AS removed FROM each e LEFT JOIN gone g USING (doc_id, i)),
        done AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed,
                   coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed), '') AS kept
            FROM marked GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN done USING (doc_id)""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS bound FROM s),
        l AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        t AS (
            SELECT source, source_size, least(bound, (SELECT max(level) FROM l) * weight) AS target,
                   CAST(('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS off
            FROM l),
        n AS (
            SELECT d.doc_id, d.size, t.*, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                   row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, CAST(least(floor(k * rate + off) - floor((k - 1) * rate + off), 2) AS BIGINT) * size AS taken FROM n""",
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
}
