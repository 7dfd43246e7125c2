"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, classifier, infill, language, lattice, lexical, licenses, minhash, mixing, pages, private_data, quality_rules, substrings
from panelkit.llm.catalog import ORACLES, QUERIES, query, table  # noqa: F401
from panelkit.llm.sampling import fold


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")



@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM d WHERE len(ws) >= 13),
g AS (SELECT doc_id, i, ws[i:i + 12] AS w FROM win),
m AS (SELECT w, min(doc_id) AS first_doc FROM g GROUP BY w),
gone AS (SELECT DISTINCT g.doc_id, g.i + k.k AS p FROM g JOIN m ON g.w = m.w AND m.first_doc < g.doc_id CROSS JOIN range(13) k(k)),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(d.ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_html_extraction")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "char_distance", "word_distance", "nearest")


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0 * source_size / weight AS ratio, sum(3 * source_size) OVER w - 3 * source_size AS caps, sum(weight) OVER w - weight AS used,
             sum(source_size) OVER () AS total, sum(weight) OVER () AS every
      FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
ok AS (SELECT arg_min(CAST(total - caps AS DOUBLE) / (every - used), used) AS level FROM r
       WHERE ratio >= CAST(total - caps AS DOUBLE) / (every - used)),
t AS (SELECT source, source_size, docs,
             CAST(CASE WHEN 3 * source_size < level * weight THEN 3 * source_size ELSE level * weight END AS DOUBLE) AS target FROM r, ok),
j AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             md5(concat(d.doc_id, ':23')) AS h, t.docs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(docs / 256.0) AS BIGINT) AS stratum FROM j),
b AS (SELECT *, floor((rate - floor(rate)) * sum(size) OVER (PARTITION BY source, stratum) + 0.5)
                - coalesce(sum(size) OVER (PARTITION BY source, stratum ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM k)
SELECT doc_id, size, source_size, target, CAST(floor(rate) * size + greatest(0, least(size, rest)) AS BIGINT) AS taken FROM b
"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "kept")


@query("op9_lattice_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lattice.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@query("op10_quality_classifier")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4) == 2
    model = classifier.fit(docs, labels.where(~held_out))
    found = classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score")
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM
      (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM f GROUP BY term), s),
i AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)) AS impact FROM f JOIN d USING (doc_id), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN i USING (term) GROUP BY ALL),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


@query("op11_ranked_search", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_data.find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(private_data.written("base"), 256).alias("base_sha256")
    return found.select("doc_id", *private_data.COUNTED, digest, private_data.written("spans").alias("spans"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
