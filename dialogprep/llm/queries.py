"""The registered queries of the training-data operators."""

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogprep.llm import (
    byte_bpe, decontaminate, jaccard, languages, licenses, lm_score, mixing, phrases,
    resample, suffix_dedup, token_files, topk, word_pieces,
)
from dialogprep.llm.common import table
from dialogprep.sources.scratch import scratch_dir


def language_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: the language of every text, learned from the documents not held out."""
    held_out = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    predicted = languages.predict(docs, languages.learn(docs.where(~held_out)))
    return predicted.select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions")


def word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: greedy word pieces of every text over a public vocabulary."""
    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ordinary = (model.id_to_piece(i) for i in range(model.get_piece_size())
                if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return word_pieces.count(
        table(spark, sf_dir, "documents"), *word_pieces.marked_pieces(ordinary))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 3: licence notices and texts within every document."""
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.TEMPLATES)


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4: passages of benchmark items within every document."""
    return decontaminate.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def suffix_dedup_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 5: what remains of every text without repeated strings of 100 bytes."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), length=100).select(
        "rest.doc_id", "n_bytes", "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6: log-probabilities of every text, learned from the documents not held out."""
    held_out = F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True))
    scored = lm_score.score(table(spark, sf_dir, "documents"), learned=~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8: components of documents that share nine tenths of their 3-word shingles."""
    joined = jaccard.join(table(spark, sf_dir, "documents"), words=3, share_=(90, 100))
    return joined.select("doc_id", "n_shingles", "component_id")


def byte_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7: ids of every text and the text decoded from them, as digests."""
    ranks = byte_bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def token_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9: ids of every text written to Huffman-coded blocks and read back."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = scratch_dir(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, definition, end_id=2)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10: the 20 best inner products of every 20th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: the 2000 best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: a tenth of the documents, drawn by importance for the benchmark's words."""
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: how many words of every document go into the mix of sources."""
    return mixing.plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {
    "op1_language_mixtures": language_mixtures,
    "op2_word_piece_counts": word_piece_counts,
    "op3_license_scan": license_scan,
    "op10_exact_topk": top_k,
    "op9_token_files": token_files_roundtrip,
    "op4_benchmark_passages": benchmark_passages,
    "op5_suffix_dedup": suffix_dedup_digest,
    "op8_jaccard_join": jaccard_join,
    "op6_recurrent_scores": recurrent_scores,
    "op7_byte_bpe_roundtrip": byte_bpe_roundtrip,
    "op11_phrase_collocations": collocations,
    "op12_importance_resample": importance_resample,
    "op13_mix_sources": mix_sources,
}

ORACLES: dict[str, str] = {
    "op10_exact_topk": """
        WITH usable AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.r <> c.r
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score, CAST(row_number() OVER (
                PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), words AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), sizes AS (
            SELECT unnest([1, 2, 3, 4]) AS m
        ), runs AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i + m - 1])) AS p
            FROM words, sizes WHERE len(w) >= m
        ), counts AS (
            SELECT lang, p, m, count(*) AS f FROM runs GROUP BY ALL
        ), totals AS (
            SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
        ), candidates AS (
            SELECT lang, p, m, f AS a FROM counts WHERE m >= 2 AND f >= 30
        ), cuts AS (
            SELECT lang, p, m, a, unnest(range(1, m)) AS k FROM candidates
        ), scored AS (
            SELECT c.lang, c.p, c.m, c.a, x.f AS l, y.f AS r,
                   CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score,
                   row_number() OVER (PARTITION BY c.lang, c.p
                       ORDER BY (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f), k) AS place
            FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k]
                        JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]
        ), inner_runs AS (
            SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda s:
                list_transform(range(1, m - s + 2), lambda i: p[i:i + s - 1])))) AS p
            FROM candidates WHERE m > 2
        ), longer AS (
            SELECT lang, p, max(a) AS longest FROM inner_runs GROUP BY lang, p
        ), kept AS (
            SELECT s.lang, array_to_string(s.p, ' ') AS phrase, s.a, s.l, s.r, s.score
            FROM scored s LEFT JOIN longer g ON g.lang = s.lang AND g.p = s.p
            WHERE place = 1 AND (longest IS NULL OR 100 * longest < 80 * s.a)
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    # CRC-32 by its table of 256 remainders, for each distinct word.
    "op12_importance_resample": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), uses AS (
            SELECT r, unnest(words) AS word FROM docs
        ), aims AS (
            SELECT unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
            FROM benchmark
        ), remainders AS (
            SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                        lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
                        ORDER BY n) AS t
            FROM (SELECT unnest(range(256)) AS n)
        ), buckets AS (
            SELECT word, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
                       range(0, length(hex(word)), 2),
                       lambda i: CAST('0x' || substr(hex(word), i + 1, 2) AS BIGINT))),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM (SELECT word FROM uses UNION SELECT word FROM aims), remainders
        ), counts AS (
            SELECT b.bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t
            FROM (SELECT unnest(range(10000)) AS bucket) b
            LEFT JOIN (SELECT bucket, count(*) AS s FROM uses JOIN buckets USING (word) GROUP BY ALL) x USING (bucket)
            LEFT JOIN (SELECT bucket, count(*) AS t FROM aims JOIN buckets USING (word) GROUP BY ALL) y USING (bucket)
        ), gains AS (
            SELECT bucket, floor(1000 * ln(
                       CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
                       / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS gain
            FROM counts
        ), weights AS (
            SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
            FROM uses JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY r
        ), scored AS (
            SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(
                       '2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE))
                       / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
            FROM docs LEFT JOIN weights USING (r)
        ), placed AS (
            SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank,
                   count(*) OVER () AS n
            FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
        FROM scored LEFT JOIN placed USING (r)
    """,
    "op13_mix_sources": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighted AS (
            SELECT source, source_size, 3 * source_size AS most,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
            FROM sources
        ), levels AS (
            SELECT most, weight, most / weight AS reach,
                   (CAST((SELECT sum(size) FROM sized) AS DOUBLE)
                    - coalesce(CAST(sum(most) OVER before AS DOUBLE), 0))
                   / CAST(sum(weight) OVER onwards AS DOUBLE) AS level
            FROM weighted
            WINDOW before AS (ORDER BY most / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   onwards AS (ORDER BY most / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), found AS (
            SELECT coalesce(min(level), 0) AS level FROM (
                SELECT level FROM levels WHERE most > weight * level ORDER BY reach LIMIT 1)
        ), targets AS (
            SELECT source, source_size,
                   CASE WHEN most <= weight * level THEN CAST(most AS DOUBLE) ELSE weight * level END AS target
            FROM weighted, found
        ), drawn AS (
            SELECT d.doc_id, d.size, t.source_size, t.target,
                   CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                   CAST('0x' || substr(sha256('2024:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)
                        AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
            FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM drawn
    """,
}
