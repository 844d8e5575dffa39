"""The registered queries of this subpackage: op<N>_<name>(spark, sf_dir), thin over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, fingerprints, licences, lines, mixing, neardup, quality, search, substrings, toxicity, trie, urls
from .shared import table, written


def tokenizer_path() -> str:
    """The byte-level vocabulary for the tokenizers library (the same ranks as the .tiktoken file)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The rules that op7 is asked for: verdict, host and path.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    lexicon, coefficients = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return toxicity.with_scores(docs.withColumn("held_out", held_out), lexicon, coefficients)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), width=2, percent=80)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("detections")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), length=100, digest=True).withColumnRenamed("kept", "kept_sha256")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered(table(spark, sf_dir, "pages").select("page_id", "url", "html"), URL_RULES).drop("block_odds")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(quality.with_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False))
    out = quality.judged(counted, quality.host_rates(counted))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, sources = mixing.mixed(table(spark, sf_dir, "documents"))
    sources = F.broadcast(sources.withColumnRenamed("source", "__source"))
    out = docs.join(sources, F.col("source").eqNullSafe(F.col("__source")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(trie.numbered(trie.digested(table(spark, sf_dir, "conversations"))))
    return trie.nodes(trie.rebuilt(turns), turns)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_dedup": op3_line_dedup,
    "op4_licence_scan": op4_licence_scan,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_source_mixing": op10_source_mixing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_fingerprints": op13_fingerprints,
}

WORD = r"[^\x20\x09-\x0D]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: In DuckDB. op8: the counts, the base rule, and the shrunk failure rate of each source. op11: crc32 bit by bit, every prefix of the
#: rebuilt conversations as a list of turns, subtrees by the conversations that pass both nodes. op12: all scores. The other queries
#: have no SQL: their models, sketches, orders and merges are tested against plain versions.
ORACLES: dict[str, str] = {
    "op8_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORD}') GROUP BY 1),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
        covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY 1),
        c AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
              FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN covered ON covered.doc_id = d.doc_id),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols > n_words AS symbols, 3 * n_dup_lines > greatest(n_words / 5, 3) AS dup_lines,
              n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS word_length FROM c),
        u AS (SELECT source, 'base' AS rule, base_failed AS failed FROM f UNION ALL SELECT source, 'symbols', symbols FROM f UNION ALL SELECT source, 'dup_lines', dup_lines FROM f UNION ALL SELECT source, 'word_length', word_length FROM f),
        h AS (SELECT rule, source, count(*) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k FROM u GROUP BY 1, 2),
        m AS (SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(k) / sum(n) AS mean, sum(k * k / n) AS kk, CAST(sum(n * n) AS DOUBLE) AS nn FROM h GROUP BY 1),
        b AS (SELECT *, (kk - docs * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(docs - nn / docs, 0) AS spread FROM m),
        p AS (SELECT rule, mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1e0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM b),
        r AS (SELECT source, bool_or((k + mean * strength) / (n + strength) >= 0.5) AS rejected FROM h JOIN p USING (rule) GROUP BY 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f LEFT JOIN r ON r.source IS NOT DISTINCT FROM f.source""",
    "op11_conversation_trie": rf"""
        WITH RECURSIVE c AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
        bits AS (SELECT c, CAST(c AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM c
            UNION ALL SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, CAST(3988292384 AS BIGINT)) ELSE y >> 1 END
            FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(s[CAST(i // 8 + 1 AS INTEGER)]) AS BIGINT)) ELSE x END AS y FROM bits WHERE i < 8 * length(s))),
        h AS (SELECT c, xor(x, CAST(4294967295 AS BIGINT)) % 4 AS h, c - c % 20 AS base FROM bits WHERE i = 8 * length(s)),
        t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
              FROM conversations WHERE conv_id IS NOT NULL),
        r AS (SELECT h.c, 0 AS own, pos, role, text FROM h JOIN t ON t.c = h.base AND pos <= h UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN t ON t.c = h.c AND pos > h),
        p AS (SELECT c, row_number() OVER w AS d, md5(CAST(list({{'r': role, 't': text}}) OVER w AS VARCHAR)) AS k, len(regexp_extract_all(text, '{WORD}')) AS words FROM r WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
        q AS (SELECT c, d, k, words FROM p UNION ALL SELECT c, 0, '', 0 FROM c),
        n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM q GROUP BY 1, 2),
        e AS (SELECT DISTINCT b.d, b.k, a.k AS up FROM q a JOIN q b ON a.c = b.c AND b.d = a.d + 1),
        kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM e GROUP BY 1, 2),
        below AS (SELECT DISTINCT a.d, a.k, b.d AS dd, b.k AS kk FROM q a JOIN q b ON a.c = b.c AND b.d >= a.d),
        sums AS (SELECT below.d, below.k, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.words) AS saved
                 FROM below JOIN n ON n.d = dd AND n.k = kk LEFT JOIN kids ON kids.d = dd AND kids.up = kk GROUP BY 1, 2),
        ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM q GROUP BY 1) GROUP BY 1, 2)
        SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
               CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN sums USING (d, k) LEFT JOIN kids ON kids.d = n.d AND kids.up = n.k LEFT JOIN e ON e.d = n.d AND e.k = n.k LEFT JOIN n up ON up.d = n.d - 1 AND up.k = e.up LEFT JOIN ends ON ends.d = n.d AND ends.k = n.k""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS w FROM documents),
        n AS (SELECT row, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
        s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length FROM n),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWERED}, '{TERM}')) AS term FROM benchmark),
        tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
        df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, n_docs),
        sc AS (SELECT item_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * n_docs) // length)))) AS score
               FROM i JOIN df USING (term) JOIN tf USING (term) JOIN n USING (row), s GROUP BY 1, 2),
        r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc JOIN n USING (row) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10""",
}
