"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, licenses, linededup, media, neardup, pii, quality, rans, search, substring, suffix
from .common import durable, table

#: Test key; production passes its own.
PSEUDONYM_KEY = b"talus example key"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(durable(media.to_media(table(spark, sf_dir, "documents")), "media"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    # text is what is kept, for readers: a character that a removed byte was part of is U+FFFD in it.
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "spans", F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source and id; every fiftieth is the licence file of its directory."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    folder = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 10000).cast("string"), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"))
    return licenses.scan(docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", folder, name).alias("path"), "text")).withColumnRenamed("file_id", "doc_id").withColumn("licenses", F.concat_ws(",", "licenses"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    back = rans.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_decontamination, op3_suffix_array_dedup, op4_quality_classifier, op5_license_scan, op6_line_dedup, op7_near_dedup, op8_pii_pseudonyms, op9_byte_bpe,
        op10_rans_token_ids, op11_substring_dedup, op12_ranked_search, op13_source_divergence,
    )
}

_TEMPLATES = ", ".join("({}, '{}', '{}', {}::VARCHAR[], {}::VARCHAR[])".format(i, a, b.replace("'", "''"), licenses.needs(b), licenses.bars(a)) for i, (a, b) in enumerate(licenses.TEMPLATES))
_DENIAL = "regexp_matches(lower({}), '" + licenses.DENIAL.replace("'", "''") + "')"
_SURE = "CASE license WHEN 'All-Rights-Reserved' THEN 1 WHEN 'BSD' THEN 2 ELSE 3 END"
_WORDS = "unnest(regexp_extract_all(lower({}), '[a-z0-9]+(?:[.-][a-z0-9]+)*'))"
_CUE = "(" + " OR ".join(f"contains(lower({{0}}), '{c}')" for c in licenses.CUES) + ")"

ORACLE = {
    "op7_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reach = e.a),
m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_license_scan": f"""
WITH files AS (SELECT doc_id, text, source || '/' || (doc_id // 10000) || '/' || (doc_id // 1000) || '/' || (doc_id // 100) AS dir, CASE WHEN doc_id % 50 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS name FROM documents),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(10), 'g'), chr(10))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.;!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), 1) AS place FROM files WHERE {_CUE.format("text")}),
n AS (SELECT doc_id, place, token, count(*) AS tf FROM (SELECT doc_id, place, {_WORDS.format("sentence")} AS token FROM s WHERE {_CUE.format("sentence")} AND NOT {_DENIAL.format("sentence")}) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM n GROUP BY token), total AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, place FROM n)),
w AS (SELECT doc_id, place, token, tf, tf * (ln((total.n + 1.0::double) / (df + 1.0::double)) + 1.0::double) AS w FROM n JOIN df USING (token), total),
norm AS (SELECT doc_id, place, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
v(template, license, notice, needs, bars) AS (VALUES {_TEMPLATES}),
t AS (SELECT template, license, token, count(*) AS ttf FROM (SELECT template, license, {_WORDS.format("notice")} AS token FROM v) GROUP BY ALL),
tw AS (SELECT template, license, token, ttf, ttf * (ln((total.n + 1.0::double) / (coalesce(df, 0) + 1.0::double)) + 1.0::double) AS tw FROM t LEFT JOIN df USING (token), total),
tn AS (SELECT *, sqrt(sum(tw * tw) OVER (PARTITION BY template)) AS tnorm FROM tw),
c AS (SELECT doc_id, place, license, template, sum(least(tf, ttf)) AS explained, round(sum(w * tw) / (norm * tnorm), 6) AS cosine FROM w JOIN tn USING (token) JOIN norm USING (doc_id, place) GROUP BY doc_id, place, license, template, norm, tnorm),
held AS (SELECT doc_id, place, list(token) AS tokens FROM n GROUP BY ALL),
best AS (SELECT c.doc_id, place, c.license, cosine, {_SURE.replace("license", "c.license")} AS sure, explained, template FROM c JOIN v USING (template) JOIN held USING (doc_id, place) WHERE cosine >= {licenses.THRESHOLD} AND list_has_all(tokens, needs) AND NOT list_has_any(tokens, bars)
QUALIFY row_number() OVER (PARTITION BY c.doc_id, place ORDER BY sure DESC, explained DESC, cosine DESC, template) = 1),
matched AS (SELECT doc_id, arg_max(license, (sure, explained, cosine, -template)) AS license, arg_max(cosine, (sure, explained, cosine, -template)) AS cosine, max(sure) AS surest, list_sort(list(DISTINCT license)) AS listed, list_sort(list(DISTINCT license) FILTER (WHERE sure = 3)) AS surer FROM best GROUP BY doc_id),
own AS (SELECT doc_id, license AS own_license, cosine, array_to_string(CASE WHEN surest = 3 THEN surer ELSE [license] END, ',') AS own_licenses FROM matched),
named AS (SELECT files.doc_id, dir, name, own_license, cosine, own_licenses FROM files LEFT JOIN own USING (doc_id)),
lic AS (SELECT dir AS ancestor, arg_max(own_license, (cosine, own_license)) AS dir_license, arg_max(own_licenses, (cosine, own_license, own_licenses)) AS dir_licenses FROM named WHERE lower(name) = 'license' AND own_license IS NOT NULL GROUP BY dir),
up AS (SELECT dir, array_to_string(string_split(dir, '/')[1:k], '/') AS ancestor FROM (SELECT dir, unnest(range(1, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM files))),
near AS (SELECT dir, arg_max(dir_license, length(ancestor)) AS inherited_license, arg_max(dir_licenses, length(ancestor)) AS inherited_licenses, arg_max(ancestor, length(ancestor)) AS inherited_from FROM up JOIN lic USING (ancestor) GROUP BY dir)
SELECT doc_id, dir || '/' || name AS path, own_license, cosine, inherited_license, inherited_from, coalesce(own_license, inherited_license) AS license, coalesce(own_licenses, inherited_licenses, '') AS licenses FROM named LEFT JOIN near USING (dir)""",
    "op6_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""",
    "op11_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT doc_id, start, sha256(array_to_string(words[start:start + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM w)),
late AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM late),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (SELECT each.doc_id, word, each.pos, gone.pos IS NOT NULL AS g FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.pos = each.pos),
r AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM k),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT g) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    "op12_ranked_search": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE doc_id IS NOT NULL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term),
part AS (SELECT tf.id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * docs) // length))) AS part FROM tf JOIN w USING (term) JOIN d ON d.id = tf.id, size),
s AS (SELECT item_id, id, doc_id, sum(part)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(kept), 0) AS kept, coalesce(any_value(lang_total), 0) AS lang_total, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
grid AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 5)::HUGEINT) // (total + 5 * g.kept) AS p, 1 + (1000000000 * (lang_n + 5)::HUGEINT) // (lang_total + 5 * g.kept) AS q FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM grid WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every QUALIFY part = 'pair' OR rank <= 50""",
}
