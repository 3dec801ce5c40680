"""Queries of the text operators: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from swatch.llm.common import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from swatch.llm.pieces import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.array_max("ends").cast("long").alias("n_bytes"))


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm import imatch

    docs = table(spark, sf_dir, "documents")
    out = imatch.compare_with_edit(docs, imatch.build_lexicon(docs))
    return out.select("doc_id", "n_chars", "edited_sha256", F.col("text_fp").alias("fingerprint"),
                      F.col("edited_fp").alias("edited_fingerprint"),
                      imatch.likeness(F.col("text_fp"), F.col("edited_fp")).alias("near_edited"),
                      imatch.likeness(F.col("text_fp"), F.col("next_fp")).alias("near_next"))


def remainder(n: int, id_col: str = "doc_id"):
    """crc32 of the id as text, modulo ``n``: what deals rows to folds."""
    return F.crc32(F.col(id_col).cast("string")) % n


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm import ppm

    docs = table(spark, sf_dir, "documents")
    counts = ppm.count_corpus(docs.where(remainder(10) != 0))
    out = ppm.score_documents(docs, counts, ppm.fit(counts))
    return out.withColumn("held_out", remainder(10) == 0).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.warc import round_trip

    pages = table(spark, sf_dir, "pages")
    out = round_trip(pages, payloads=False)
    kind = pages.schema["page_id"].dataType
    return out.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast(kind).alias("refers_to"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.secrets import BASE, find_secrets, spell

    out = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.filter("parts", lambda p: p["kind"] == kind)
    base = F.filter("parts", lambda p: p["kind"].isin(*BASE))
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
                      F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("parts")).alias("spans"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.repeats import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm import languages

    docs = table(spark, sf_dir, "documents")
    model = languages.fit(docs.where(remainder(3) != 1))
    out = languages.identify(docs, model)
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm import toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(remainder(4) != 2).select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text").join(known, "doc_id"))
    out = toxicity.score_documents(docs, model)
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score",
                      F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.licenses import find_licenses

    out = find_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      *[F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")], "score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm import merkle

    docs = table(spark, sf_dir, "documents")
    changed = merkle.leaf([F.try_add(docs[f], F.lit(1)) if f == "n_chars" else docs[f] for f in merkle.FIELDS])
    out = merkle.manifest(docs, carry={"changed": F.when(remainder(7) == 0, changed)})
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("steps"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("steps")).alias("proof_sha256"),
                      folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from swatch.llm.negatives import mine_hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", "embedding", moved.alias("label"))
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_sentencepiece": op1_sentencepiece,
    "op2_imatch": op2_imatch,
    "op3_ppm": op3_ppm,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_jaccard": op7_jaccard,
    "op8_repeats": op8_repeats,
    "op9_language_id": op9_language_id,
    "op10_toxicity": op10_toxicity,
    "op11_licenses": op11_licenses,
    "op12_merkle": op12_merkle,
    "op13_hard_negatives": op13_hard_negatives,
}



def _leaf_sql(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


def _crc32_sql(text: str) -> str:
    """CRC-32 of a short ASCII text: a bit at a time, by the reflected polynomial."""
    bits = "list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda k: 0::BIGINT)), " \
           "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), "
            f"lambda x: ascii(x)::BIGINT)), lambda a, b: {bits}), 4294967295)")


SQL: dict[str, str] = {
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM q WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM q LEFT JOIN f USING (payload_digest)""",
    "op12_merkle": f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
                 CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("n_chars + 1")} END AS changed
          FROM documents),
        leaves AS (
          SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                 count(*) OVER (PARTITION BY lang) AS n FROM d),
        tree AS (
          SELECT lang, 0 AS level, pos, leaf AS h, n FROM leaves
          UNION ALL
          SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
          FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
        subs AS (
          SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n,
                 level AS height FROM tree WHERE n = 1),
        top AS (
          SELECT 0 AS level, pos, subroot AS h, n FROM subs
          UNION ALL
          SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
          FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
        up AS (
          SELECT l.doc_id, l.lang, l.leaf, l.pos, s.pos AS top_pos, s.height, 0 AS step, coalesce(l.changed, l.leaf) AS h,
                 '' AS proof, s.height + (SELECT max(level) FROM top) AS steps, s.subroot
          FROM leaves l JOIN subs s ON l.lang IS NOT DISTINCT FROM s.lang
          UNION ALL
          SELECT u.doc_id, u.lang, u.leaf, u.pos, u.top_pos, u.height, u.step + 1,
                 sha256(CASE WHEN u.at % 2 = 1 THEN coalesce(t.h, r.h, '') || u.h ELSE u.h || coalesce(t.h, r.h, '') END),
                 u.proof || coalesce(t.h, r.h, ''), u.steps, u.subroot
          FROM (SELECT *, CASE WHEN step < height THEN pos >> step ELSE top_pos >> (step - height) END AS at
                FROM up WHERE step < steps) u
          LEFT JOIN tree t ON u.step < u.height AND t.level = u.step AND t.lang IS NOT DISTINCT FROM u.lang
                          AND t.pos = xor(u.at, 1)
          LEFT JOIN top r ON u.step >= u.height AND r.level = u.step - u.height AND r.pos = xor(u.at, 1))
        SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
               h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified
        FROM up WHERE step = steps""",
    "op13_hard_negatives": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.r AS a, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same,
                 CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
          FROM v a JOIN v ON a.r <> v.r WHERE a.vec_id % 50 = 0),
        p AS (
          SELECT * FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, r) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (
                 PARTITION BY p.a, p.r ORDER BY s.score DESC, s.vec_id NULLS LAST, s.r) AS INTEGER) AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY rank <= 3""",
}
