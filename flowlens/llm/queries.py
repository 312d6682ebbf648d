"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import duplicate_lines

    return duplicate_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "dropped")


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op4_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op8_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lang_id import identify

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return identify(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_conversations

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(format_conversations(rows.union(hostile)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .variants import group_variants, vocabulary

    return group_variants(vocabulary(table(spark, sf_dir, "documents"), least_chars=6, least_count=5, slip_every=199))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_fuzzy_line_dedup, op3_quality_divergence, op4_mix_to_targets, op5_license_scan, op6_exact_top_k, op7_ngram_lm_scoring, op8_warc_zstd, op9_bpe, op10_language_id, op11_qdwh_whitening, op12_chat_format, op13_spelling_variants)}
SQL: dict[str, str] = {
    "op6_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) e from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) score
              from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
        select query_id, cast(r as int) as rank, vec_id, cast(score as bigint) as score from
        (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 10""",
    "op12_chat_format": r"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
        select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
               cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) loss_sha256,
               cast(sum(length(text) + len(regexp_extract_all(text, '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|'))
                        + case role when 'user' then 18 when 'assistant' then 6 when 'system' then 19 else 14 + length(url_encode(role)) end) as bigint) formatted_chars
        from c group by conv_id""",
}
