"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, exact, idfile, langid, lines, mixing, pieces, pii, repair, rules, simhash, variants
from tallyspark.llm.common import documents, given
from tallyspark.plans.shared import new_path, written

#: Folder of the vocabulary files.
VOCABULARIES = os.environ.get("TALLY_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(
    r"""
    WITH n AS (
        SELECT doc_id, length(coalesce(text, '')) AS n,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS x
        FROM documents
    ), g AS (
        SELECT doc_id, x, first_value(doc_id) OVER (PARTITION BY x ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY x) AS group_size
        FROM n
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM g
    """
)
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


#: The text of an added conversation, which looks like the template's own marks.
PROBE = r"\### Assistant: </turn> ok"


@query(
    r"""
    WITH c AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    ), e AS (
        SELECT *, lag(role) OVER w AS prior, row_number() OVER w AS place,
            length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) AS chars,
            coalesce(length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')), 2) AS role_chars
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        sum(chars + 7 + CASE WHEN place = 1 OR prior IS DISTINCT FROM role THEN role_chars + 7 ELSE 0 END)::BIGINT
            AS formatted_chars
    FROM e GROUP BY conv_id
    """
)
def op4_chat_format(spark, sf_dir):
    probe = spark.range(2).select(
        F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    )
    turns = given(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    read = chat.read_chats(written(chat.format_chats(turns), "chats"))
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op6_simhash(spark, sf_dir):
    return simhash.simhash_groups(documents(spark, sf_dir))


@query(
    r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
        FROM documents
    ), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
    ), w AS (
        SELECT source, source_size, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS wanted,
            [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
        FROM s
    ), p AS (
        SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
            sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS upfrom
        FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source)
    ), q AS (SELECT *, (wanted - prior) * w >= cap * upfrom AS stops FROM p
    ), t AS (
        SELECT source, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE
            w * ((wanted - coalesce(sum(cap) FILTER (WHERE stops) OVER (), 0)::DOUBLE)
                 / (sum(w) FILTER (WHERE NOT stops) OVER ())::DOUBLE) END AS target
        FROM q
    ), c AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
            target - whole * source_size AS rest, rest / source_size AS pi
        FROM t
    ), r AS (
        SELECT d.doc_id, d.source, d.size, source_size, target, whole, rest,
            (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|mix'), 1, 13))::BIGINT + 0.5::DOUBLE)
                / 4503599627370496::DOUBLE AS u,
            CASE WHEN rest > 0 AND source_size > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS ratio,
            ratio / (1 + ratio) AS place
        FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
    ), z AS (
        SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM r
    )
    SELECT doc_id, size, source_size, target,
        (size * (whole + CASE WHEN place IS NOT NULL AND upto - size / 2 < rest THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM z
    """
)
def op5_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


@query()
def op7_quality_rules(spark, sf_dir):
    judged = rules.quality_rules(documents(spark, sf_dir))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


@query()
def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4
    model = langid.train(docs, remainder != 2)
    return langid.identify(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), "lang_pred", "score"
    )


def _listed(spans):
    place = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(place, ",")


@query()
def op3_personal_data(spark, sf_dir):
    found = pii.find_personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id", *[f"n_{k}" for k in pii.KINDS],
        F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"),
    )


@query()
def op10_bpe_codec(spark, sf_dir):
    return bpe.digest_documents(documents(spark, sf_dir), f"{VOCABULARIES}/word_bpe_49k.json")


@query()
def op2_token_files(spark, sf_dir):
    path = new_path(spark, "token-ids")
    idfile.write_ids(documents(spark, sf_dir), f"{VOCABULARIES}/byte_bpe_50k.json", path)
    return idfile.document_digests(spark, path)


@query()
def op8_line_dedup(spark, sf_dir):
    return lines.line_report(documents(spark, sf_dir))


@query()
def op11_piece_codec(spark, sf_dir):
    return pieces.digest_documents(documents(spark, sf_dir), f"{VOCABULARIES}/piece_bpe_32k.model")


@query()
def op12_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(variants.document_words(documents(spark, sf_dir)))


@query()
def op13_conversation_repair(spark, sf_dir):
    return repair.repair_conversations(repair.damaged(given(spark, sf_dir, "conversations")))
