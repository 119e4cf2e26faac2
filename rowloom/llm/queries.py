"""One query per corpus operator, over its whole table, with production parameters; SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import (
    filter_audit, html_text, jaccard_join, mixing, packing, prefix_trie, quality_model, quality_rules, secret_scan,
    substring_dedup, token_rollup, vector_search, warc,
)
from rowloom.llm.common import table, words_of
from rowloom.llm.tokens import token_count
from rowloom.session import new_folder, written

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after removal; the removed stretches and the ids that keep them."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "text", F.size("_removed").alias("n_removed"),
        F.aggregate("_removed", F.lit(0), lambda total, r: total + r["n"]).alias("removed_words"),
        F.transform("_removed", lambda r: F.array(r["first"], r["n"])).alias("removed"),
        F.sort_array("_kept_in").alias("kept_in"),
    )


#: The tree is domain, language, source; domains are thirds of the sources by number.
LEVELS = ("domain", "lang", "source")
#: Weights among siblings; branches without one have weight 1.
WEIGHTS = {
    ("0",): 2.0, ("1",): 1.0, ("2",): 1.0,
    **{(d, "en"): 4.0 for d in "012"}, **{(d, lang): 1.0 for d in "012" for lang in ("de", "es", "fr")},
}


def domain_of(source) -> F.Column:
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d+)$", 1)
    return F.pmod(F.coalesce(number.try_cast("bigint"), F.lit(0)), F.lit(3)).cast("string")


def mixed_documents(docs: DataFrame, share: float, seed: int = 1) -> DataFrame:
    levels = [domain_of(F.col("source")), F.col("lang"), F.col("source")]
    return mixing.mix(docs, levels, WEIGHTS, share, epochs=2, seed=seed)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents, a row per epoch, for a mixture of 60 % of all tokens."""
    chosen = mixed_documents(table(spark, sf_dir, "documents"), 0.6)
    return chosen.select(
        "doc_id", F.col("_epoch").alias("epoch"), domain_of(F.col("source")).alias("domain"), "lang", "source",
        mixing.word_tokens(F.col("text")).alias("n_tokens"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes(F.col("failed"), quality_rules.BASE)).alias("base_failed"), "kept", "failed",
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents under two tokenizers, copies deleted, documents with repeated lines revised."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    named = docs.withColumn("t", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(7), "text"))
    copies = named.groupBy("t", "t2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    lines = F.split("text", "\n")
    shorter = F.when(F.size(lines) > F.size(F.array_distinct(lines)), F.array_join(F.array_distinct(lines), "\n"))
    path = tokenizer_path()
    counted = written(
        named.withColumn("revised", shorter).select(
            "doc_id", "lang", "source", "t", "t2", F.col("revised").isNotNull().alias("is_revised"),
            token_count(F.col("text"), path).alias("bpe"), F.size(words_of(F.col("text"))).alias("words"),
            token_count(F.col("revised"), path).alias("new_bpe"), F.size(words_of(F.col("revised"))).alias("new_words"),
        ),
        "token-counts",
    )
    is_copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))
    state = written(counted.join(copies, ["t", "t2"], "left").withColumn("is_copy", is_copy).drop("t", "t2", "first"), "token-states")
    rollup = token_rollup.Rollup(spark, new_folder(spark, "token-rollup"))
    signed = token_rollup.changes
    versions = {"byte_bpe_50k": "bpe", "words": "words"}
    for name, column in versions.items():
        rollup.commit(f"insert-{name}", signed(state, name, F.col(column)))
    gone = state.where("is_copy")
    revised = state.where("is_revised and not is_copy")
    for name, column in versions.items():
        rollup.commit(f"copies-{name}", signed(gone, name, F.col(column), -1))
        change = signed(revised, name, F.col(column), -1).unionByName(signed(revised, name, F.col(f"new_{column}")))
        rollup.commit(f"revised-{name}", change)
    rollup.commit("copies-words", signed(gone, "words", F.col("words"), -1))  # sent twice, counted once
    return rollup.totals()


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_substring_dedup, op3_source_mixing, op4_html_extraction, op5_quality_rules,
        op6_quality_classifier, op7_nearest_neighbours, op8_warc, op9_token_counts, op10_ngram_jaccard_join,
        op11_filter_audit, op12_secret_scan, op13_prefix_trie,
    )
}

_QUALITY = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
              + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
              + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
              + CASE WHEN 100 * n_shouts > 50 * n_words THEN 8 ELSE 0 END
              + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
              + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 32 ELSE 0 END AS failed
      FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed = 0 AS kept, failed
FROM b"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS d
           FROM pages),
v AS (SELECT page_id, payload_bytes,
             list_transform(range(4), lambda i: CAST('0x' || substr(d, CAST(1 + 10 * i AS INT), 10) AS BIGINT)) AS groups,
             min(page_id) OVER (PARTITION BY html) AS first_id
      FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((groups[1 + i // 8] >> (35 - 5 * (i % 8))) & 31) AS INT), 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM v"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (SELECT DISTINCT rid, gram FROM (
        SELECT rid, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
        FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w WHERE len(words) >= 3)
        UNION ALL SELECT rid, array_to_string(words, ' ') FROM w WHERE len(words) IN (1, 2))),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.rid < b.rid GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rid AS a, rid AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT r.a AS rid, min(w.doc_id) AS component_id FROM r JOIN w ON w.rid = r.b GROUP BY r.a),
k AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, coalesce(k.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (rid) LEFT JOIN m USING (rid) LEFT JOIN k USING (rid)"""

_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part,
             CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS failed
      FROM d),
n AS (SELECT part, failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
      FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
c AS (SELECT 'ABCDE'[i] AS letter, 1 << (i - 1) AS bit FROM (SELECT unnest(generate_series(1, 5)) AS i)),
o AS (SELECT [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits, v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order
      FROM c v, c w, c x, c y, c z WHERE (v.bit | w.bit | x.bit | y.bit | z.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step]) - bits[step] AS gone
      FROM (SELECT *, unnest(generate_series(1, 5)) AS step FROM o)),
r AS (SELECT part, filter_order, step, s.bit,
             sum(CASE WHEN failed & (gone | s.bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN failed & gone = 0 AND failed & s.bit > 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN failed & gone > 0 AND failed & s.bit > 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN failed = s.bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN failed & gone = 0 AND failed & s.bit > 0 THEN n * good ELSE 0 END) AS good_lost,
             sum(CASE WHEN failed & gone = 0 AND failed & s.bit > 0 THEN n * toxic ELSE 0 END) AS toxic_lost
      FROM n, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""

_TRIE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (
             PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
           FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 20 AS base, xor(list_reduce(
               list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
               lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                 lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT v.c, p, r, x FROM v JOIN t ON t.c = v.base AND p <= h UNION ALL SELECT c, p, r, x FROM t JOIN v USING (c) WHERE p > h),
d AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY p) AS depth, {'r': r, 'x': x} AS turn FROM b),
k AS (SELECT c, depth, list(turn) OVER (PARTITION BY c ORDER BY depth) AS key,
             len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM d
      UNION ALL SELECT c, 0, [], 0 FROM v),
n AS (SELECT key, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM k GROUP BY key, depth),
u AS (SELECT n.key, p.key AS parent, q.conv_id AS parent_conv_id
      FROM n JOIN k p ON p.c = n.conv_id AND p.depth = n.depth - 1 JOIN n q ON q.key = p.key),
f AS (SELECT parent AS key, count(*) AS n_children FROM u GROUP BY parent),
s AS (SELECT a.key, sum(CASE WHEN f.key IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
      FROM n LEFT JOIN f USING (key) JOIN k a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.key),
e AS (SELECT key, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(key, depth) AS key FROM k GROUP BY c) GROUP BY key)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN u USING (key) LEFT JOIN f USING (key) LEFT JOIN s USING (key) LEFT JOIN e USING (key)"""

SQL = {"op11_filter_audit": _AUDIT, "op13_prefix_trie": _TRIE, "op5_quality_rules": _QUALITY, "op8_warc": _WARC, "op10_ngram_jaccard_join": _JACCARD}
