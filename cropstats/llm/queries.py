"""The queries of the operators over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropstats.llm import chat, exact_dedup, hnsw, html_text, jaccard, lexical, merkle, nbest, packing, passages, quality, scratch, suffix_dedup, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Path of the public byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digests(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, ["doc_id"]).select("row.doc_id", "held_out", "score", "predicted")


def op5_token_ids_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), path, byte_bpe())
    return token_files.digests(token_files.read(spark, path))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def piece_bpe() -> str:
    """Path of the public SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_nbest_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.segmentations(table(spark, sf_dir, "documents"), piece_bpe())


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=20)


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.written(chat.formatted(turns.unionByName(hostile))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw_neighbours": op1_hnsw_neighbours,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_ids_orc": op5_token_ids_orc,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_nbest_segmentation": op8_nbest_segmentation,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_html_extraction": op10_html_extraction,
    "op11_ranked_search": op11_ranked_search,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op2_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, coalesce(length(text), 0) AS size,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
            FROM documents),
        best AS (
            SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY size DESC, doc_id) AS keep_id
            FROM normal GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM normal JOIN best USING (text_sha256)""",
    "op11_ranked_search": """
        WITH words AS (
            SELECT id, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS id, doc_id, text FROM documents)),
        tfs AS (SELECT id, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY id, term),
        docs AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY id),
        totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
        weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs),
        asked AS (
            SELECT item_id, term, count(*) AS times
            FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
            GROUP BY item_id, term),
        scored AS (
            SELECT item_id, id, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN docs USING (id), totals GROUP BY item_id, id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op12_chat_formatting": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS given_role, text AS given_text FROM conversations
            UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'))),
        escapes AS (
            SELECT *,
                   length(role || text) - length(replace(role || text, chr(92), '')) + length(role) - length(replace(role, chr(10), '')) AS slashes
            FROM turns),
        sized AS (
            SELECT *, slashes + list_sum(list_transform(['<|im_start|>', '<|im_end|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>'],
                          lambda c: (length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c))) AS more
            FROM escapes)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, given_role NULLS FIRST, given_text NULLS FIRST)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, given_role NULLS FIRST, given_text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text) + length('<|im_end|>') + 1 + more) AS BIGINT) AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op13_merkle_manifest": """
        WITH RECURSIVE given AS (
            SELECT row_number() OVER () AS id, doc_id, source, lang, n_chars, text,
                   list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                               lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                                        lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS crc
            FROM documents),
        head AS (
            SELECT id, doc_id, source, text, crc,
                   coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
                   || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS first
            FROM given),
        hashed AS (
            SELECT id, doc_id, source, sha256(first || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
                   CASE WHEN xor(crc, 4294967295) & 1 = 0 THEN sha256(first || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) END AS tampered
            FROM head),
        leaves AS (
            SELECT id, doc_id, source, leaf, coalesce(tampered, leaf) AS given_leaf,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
            FROM hashed),
        tree AS (
            SELECT source, 0 AS level, place, leaf AS hash, n FROM leaves
            UNION ALL
            SELECT source, level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), any_value((n + 2) // 3) FROM tree WHERE n > 1 GROUP BY source, level, place // 3),
        tops AS (
            SELECT source, hash AS subroot, level AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (
            SELECT 0 AS level, place, subroot AS hash, n FROM tops
            UNION ALL
            SELECT level + 1, place // 3, sha256(string_agg(hash, '' ORDER BY place)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, place // 3),
        steps AS (
            SELECT source, level, place, false AS upper, hash FROM tree WHERE n > 1 UNION ALL SELECT s.source, t.level + s.height, t.place, true, t.hash
            FROM top t CROSS JOIN (SELECT source, height, place FROM tops) s WHERE t.n > 1),
        runs AS (
            SELECT source, level, place, upper,
                   coalesce(string_agg(hash, '' ORDER BY place) OVER (PARTITION BY source, level, place // 3 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(hash, '' ORDER BY place) OVER (PARTITION BY source, level, place // 3 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM steps),
        folds AS (
            SELECT l.id, l.source, 0 AS level, l.place, l.given_leaf AS hash, '' AS proof, t.height, t.place AS above
            FROM leaves l JOIN tops t ON l.source IS NOT DISTINCT FROM t.source
            UNION ALL
            SELECT f.id, f.source, f.level + 1, r.place // 3, sha256(r.before || f.hash || r.after), f.proof || r.before || r.after, f.height, f.above
            FROM folds f JOIN runs r ON f.source IS NOT DISTINCT FROM r.source AND f.level = r.level AND r.place = CASE WHEN f.level = f.height THEN f.above ELSE f.place END),
        ends AS (SELECT id, max_by(hash, level) AS folded_root, sha256(max_by(proof, level)) AS proof_sha256 FROM folds GROUP BY id)
        SELECT l.doc_id, l.leaf, t.subroot, (SELECT hash FROM top WHERE n = 1) AS root, e.proof_sha256, e.folded_root,
               e.folded_root = (SELECT hash FROM top WHERE n = 1) AS verified
        FROM leaves l JOIN ends e USING (id) JOIN tops t ON l.source IS NOT DISTINCT FROM t.source""",
}
