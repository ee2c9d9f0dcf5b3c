"""The corpus operators' queries and their SQL; ``__spark_entry__`` adds them if this package can be imported."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm import alignment, exact_dedup, language_id, license_scan, media, mixing, packing, secret_scan, sharding, simhash, token_counts, warc
from labelforge.llm.common import ensure_checkpoint_dir, table

#: Production parameters.
SOURCES = [f"src{i}" for i in range(20)]
WEIGHTS, OTHER_WEIGHT = dict.fromkeys(SOURCES, 1.0) | {"src0": 4.0}, 1.0
N_SHARDS = 24
MAY_LEARN = "crc32(binary(string(doc_id))) % 3 <> 1"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.assign_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media.from_media(media.to_media(table(spark, sf_dir, "documents")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("dct_hash")).alias("feature"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, WEIGHTS, OTHER_WEIGHT)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = warc.write_bundles(table(spark, sf_dir, "pages"))
    stored = warc.store(bundles, ensure_checkpoint_dir(spark))
    found = warc.read_indexed(stored, with_payload=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = language_id.sample_training(docs, MAY_LEARN)
    found = language_id.identify(docs, training)
    return found.select("doc_id", F.expr(f"not coalesce({MAY_LEARN}, true)").alias("held_out"), "lang_pred", "score")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, max_distance=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(dictionary=tokenizer("word_bpe_49k.json")), path_col="source")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), N_SHARDS).withColumn("law", F.lit("key"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


#: Jump hashing over wide integers, step by step; CRC-32 by its bitwise rule on each byte's table entry.
SHARDING_SQL = """
    WITH RECURSIVE bits AS (SELECT range AS n, range::UBIGINT AS c, 0 AS i FROM range(256) UNION ALL
        SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8),
    crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE i = 8),
    docs AS (SELECT doc_id, encode(coalesce(text, '')) AS b, md5(coalesce('=' || doc_id, '-')) AS d FROM documents),
    told AS (SELECT doc_id, octet_length(b) + 8 AS size, d,
        xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::UBIGINT)), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
        FROM docs, crc),
    walk AS (SELECT n, d, ('0x' || d[1:16])::UBIGINT::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM (SELECT DISTINCT d FROM docs), (SELECT unnest([24, 25]) AS n) UNION ALL
        SELECT n, d, key, j, floor((j + 1) * (2147483648::DOUBLE / ((key // 8589934592)::DOUBLE + 1)))::BIGINT
        FROM (SELECT n, d, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS key, j FROM walk WHERE j < n)),
    ended AS (SELECT d, max(b) FILTER (n = 24)::INT AS shard, max(b) FILTER (n = 25)::INT AS grown_shard FROM walk WHERE j >= n GROUP BY d)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM told JOIN ended USING (d)"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_exact_dedup, op4_media_columns, op5_packing, op6_mixing, op7_warc, op8_language_id, op9_simhash, op10_secret_scan, op11_sharding, op12_alignment)}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_sharding": SHARDING_SQL,
        "op3_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
