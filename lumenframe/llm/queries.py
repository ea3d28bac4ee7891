"""The queries opN_<name> of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenframe.llm import bpe_transducer, decontamination, hard_negatives, language_id, lexical_search, license_scan, ngram_jaccard, packing, pii_surrogates, quality_classifier, quality_rules, substring_dedup, token_wavelet
from lumenframe.llm._shared import crc_mod


#: Of the registered queries alone; a user passes a secret.
PII_KEY = "registered-query"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.repetition_rules(_docs(spark, sf_dir), min_repeat=8, max_covered_percent=15, max_longest=40)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "base_failed", "kept")


def op2_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_docs(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_docs(spark, sf_dir), window=13, digest=True)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace(_docs(spark, sf_dir), key=PII_KEY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    out = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs, ~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality_classifier.fit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out, label="quality")
    out = quality_classifier.score(_docs(spark, sf_dir), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(_docs(spark, sf_dir), words=5, percent=75)


def op8_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_wavelet.token_offsets(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_transducer.encode_decode(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=8, share=0.3)


def op11_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, size=2048)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", label, F.col("vec_id") % 50 == 0, scale=256, positives=5, negatives=3, low_percent=50, high_percent=95)


def op13_length_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), most=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_license_digests": op2_license_digests,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_token_wavelet": op8_token_wavelet,
    "op9_bpe_transducer": op9_bpe_transducer,
    "op10_template_decontamination": op10_template_decontamination,
    "op11_sum_of_squares_packing": op11_sum_of_squares_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_length_stratified_search": op13_length_stratified_search,
}

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_COVER = """
win{k} AS (SELECT doc_id, i, array_to_string(w[i : i + {k} - 1], ' ') AS s FROM d, unnest(range(1, len(w) - {k} + 2)) AS r(i)),
twice{k} AS (SELECT doc_id, s FROM win{k} GROUP BY ALL HAVING count(*) > 1),
n{k} AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win{k} JOIN twice{k} USING (doc_id, s), unnest(range(0, {k})) AS r(j) GROUP BY doc_id)"""

def _canonical_sql(x: str) -> str:
    out = f"lower({x})"
    out = f"CASE WHEN regexp_matches({out}, '{license_scan.COPYRIGHT}') THEN regexp_extract({out}, '{license_scan.NOTICE}', 1) ELSE {out} END"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for a, b in license_scan.SPELLINGS:
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return f"trim({out})"


_SQL_MARK = r"\x01"
_quoted = lambda x: "'" + x.replace("'", "''") + "'"

SQL: dict[str, str] = {
    "op2_license_digests": rf"""
WITH known AS (SELECT DISTINCT license, sha256({_canonical_sql("text")}) AS digest FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in license_scan.KNOWN)}) AS k(license, text)),
picked AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents WHERE regexp_matches(text, '{license_scan.CLUE}')),
line AS (SELECT n, doc_id, 0 AS k, i, l FROM (SELECT n, doc_id, string_split(text, chr(10)) AS x FROM picked), unnest(x) WITH ORDINALITY AS r(l, i)),
para AS (SELECT n, doc_id, k, p FROM (SELECT n, doc_id, regexp_split_to_array(text, '{license_scan.BLANK}') AS x FROM picked WHERE regexp_matches(text, '{license_scan.BLANK}')), unnest(x) WITH ORDINALITY AS r(p, k)
         WHERE contains(trim(p, {_quoted(license_scan.SPACE)}), chr(10)) AND regexp_matches(p, '{license_scan.CLUE}')),
pline AS (SELECT n, doc_id, k, i, l FROM (SELECT n, doc_id, k, string_split(p, chr(10)) AS x FROM para), unnest(x) WITH ORDINALITY AS r(l, i)),
whole AS (SELECT 'document' AS scope, n, doc_id, k, i, {_canonical_sql("l")} AS t FROM line UNION ALL SELECT 'paragraph', n, doc_id, k, i, {_canonical_sql("l")} FROM pline),
unit AS (SELECT doc_id, 'line' AS scope, {_canonical_sql("l")} AS t FROM line WHERE regexp_matches(l, '{license_scan.CLUE}')
         UNION ALL SELECT doc_id, scope, string_agg(t, ' ' ORDER BY i) FROM whole WHERE t <> '' GROUP BY scope, n, doc_id, k)
SELECT doc_id, license, scope, count(*) AS n_matches FROM unit JOIN known ON sha256(t) = digest WHERE t <> '' GROUP BY ALL""",
    "op1_suffix_repetition": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
{_COVER.format(k=5)}, {_COVER.format(k=8)},
win41 AS (SELECT doc_id, array_to_string(w[i : i + 40], ' ') AS s FROM d, unnest(range(1, len(w) - 39)) AS r(i)),
long AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM win41 GROUP BY doc_id, s HAVING count(*) > 1)),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(n5.n, 0)::BIGINT AS n_repeat_words, coalesce(n8.n, 0)::BIGINT AS n_covered_words, long.doc_id IS NOT NULL AS too_long
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN n5 USING (doc_id) LEFT JOIN n8 USING (doc_id) LEFT JOIN long USING (doc_id))
SELECT * EXCLUDE too_long, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * n_covered_words <= 15 * n_words AND NOT too_long AS kept FROM base""",
    "op3_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
        FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN least USING (s), unnest(range(0, 13)) AS r(j) WHERE m < doc_id),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op7_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS r(i)
         UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
lk AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (SELECT a AS doc_id, a AS r FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r), d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_template_decontamination": rf"""
WITH raw AS (SELECT 0 AS kind, doc_id AS id, replace(coalesce(text, ''), chr(1), ' ') AS x FROM documents WHERE doc_id IS NOT NULL
        UNION ALL SELECT 1, item_id, replace(coalesce(text, ''), chr(1), ' ') FROM benchmark WHERE item_id IS NOT NULL),
nm AS (SELECT kind, id, x, regexp_replace(regexp_replace(x, '{decontamination.CAPITAL}', '\1' || chr(1) || 'm\2', 'g'), '{decontamination.NO_NAME.replace(chr(1), _SQL_MARK)}', '\1', 'g') AS y FROM raw),
form AS (SELECT kind, id, 1 AS form, x FROM nm UNION ALL SELECT kind, id, 0, y FROM nm WHERE contains(y, chr(1))),
bare AS (SELECT kind, id, form, list_transform(regexp_extract_all(x, '{decontamination.WORD.replace(chr(1), _SQL_MARK)}'), lambda x: lower(x)) AS w FROM form),
tok AS (SELECT kind, id, form, w AS bare, list_transform(w, lambda x, i: CASE WHEN regexp_full_match(x, '{decontamination.NUMBER_WORDS}') THEN chr(1) || 'n' || x
          WHEN regexp_full_match(x, '{decontamination.UNITS}') AND regexp_full_match(w[i - 1], '[0-9].*|{decontamination.NUMBER_WORDS}') THEN chr(1) || 'u' || x ELSE x END) AS w FROM bare),
tm AS (SELECT kind, id, form, list_transform(w, lambda x: CASE WHEN x[1] = chr(1) OR regexp_matches(x, '^[0-9]') THEN x ELSE '' END) AS v,
          list_transform(w, lambda x: CASE WHEN x[1:2] = chr(1) || 'u' THEN '<unit>' WHEN x[1:2] = chr(1) || 'm' THEN '<name>'
          WHEN x[1:2] = chr(1) || 'n' OR regexp_matches(x, '^[0-9]') THEN '<num>' ELSE x END) AS t FROM tok),
win AS (SELECT kind, id, form, i, CASE WHEN list_contains(v[i : i + 7], '') THEN array_to_string(t[i : i + 7], ' ') ELSE '=' || array_to_string(v[i : i + 7], ' ') END AS s,
          list_filter(v[i : i + 7], lambda x: x <> '') AS v FROM tm, unnest(range(1, len(t) - 6)) AS r(i)),
item AS (SELECT id, form, s, min(i) AS i, arg_min(v, i) AS v FROM win WHERE kind = 1 GROUP BY id, form, s),
sizes AS (SELECT id, form, count(*) AS item_windows FROM item GROUP BY ALL),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, form, d.i - b.i AS shift, b.i, b.v AS bv, d.v AS dv FROM win d JOIN item b USING (form, s) WHERE d.kind = 0),
shifts AS (SELECT *, sum(CASE WHEN before IS NULL OR shift - before >= (item_windows + 7) / 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id, form ORDER BY shift) AS run
        FROM (SELECT *, lag(shift) OVER (PARTITION BY doc_id, item_id, form ORDER BY shift) AS before
              FROM (SELECT DISTINCT doc_id, item_id, form, shift FROM hit) JOIN (SELECT id AS item_id, form, item_windows FROM sizes) USING (item_id, form))),
lv AS (SELECT hit.*, item_windows, l AS level, CASE l WHEN 0 THEN 0 WHEN 1 THEN run ELSE shift END AS place
       FROM hit JOIN shifts USING (doc_id, item_id, form, shift), unnest([0, 1, 2]) AS u(l)),
pair AS (SELECT DISTINCT doc_id, item_id, form, level, place, unnest(bv) AS x, unnest(dv) AS y FROM lv),
ok AS (SELECT doc_id, item_id, form, level, place, bool_and(x = y) AS same, count(*) = count(DISTINCT x) AS one FROM pair GROUP BY ALL),
n AS (SELECT doc_id, item_id, form, item_windows, level, place, count(DISTINCT i) AS n_all, count(DISTINCT i) FILTER (bv = dv) AS n_own FROM lv GROUP BY ALL),
best AS (SELECT doc_id, item_id, form, item_windows, coalesce(same OR one, true) AND level = 0 AS whole, coalesce(same OR NOT one, true) AS exact,
        CASE WHEN coalesce(same OR one, true) THEN n_all ELSE n_own END AS n FROM n LEFT JOIN ok USING (doc_id, item_id, form, level, place)),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n / item_windows DESC, form) AS k
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, form ORDER BY whole DESC, exact DESC, n DESC) AS f FROM best WHERE n >= 0.3 * item_windows) WHERE f = 1),
few AS (SELECT DISTINCT id, len(w) AS n, array_to_string(bare, ' ') AS s FROM tok
        WHERE kind = 1 AND form = 1 AND len(w) BETWEEN 3 AND 7 AND len(list_filter(w, lambda x: NOT (x[1] = chr(1) OR regexp_matches(x, '^[0-9]')))) > 0),
low AS (SELECT id, bare AS x FROM tok WHERE kind = 0 AND form = 1),
part AS (SELECT id, n, array_to_string(x[i : i + n - 1], ' ') AS s FROM low, (SELECT DISTINCT n FROM few), unnest(range(1, len(x) - n + 2)) AS r(i))
SELECT doc_id, item_id, n AS n_windows, item_windows, CASE WHEN exact THEN 'exact' ELSE 'reparameterised' END AS kind FROM top WHERE k = 1
UNION ALL SELECT DISTINCT part.id, few.id, 1, 1, 'exact' FROM part JOIN few USING (n, s)""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2]))::BIGINT AS s FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0),
pos AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM pair WHERE same) WHERE k <= 5),
neg AS (SELECT p.a, p.b AS p, p.s AS ps, n.b AS n, n.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS k
        FROM pos p JOIN pair n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, p AS positive_id, k::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM neg WHERE k <= 3""",
    "op13_length_stratified_search": rf"""
WITH raw AS (SELECT 0 AS kind, row_number() OVER () AS k, doc_id AS id, text FROM documents UNION ALL SELECT 1, 0, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT kind, k, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS t FROM raw),
d AS (SELECT k, id, count(*) AS n FROM w WHERE kind = 0 GROUP BY ALL), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
dm AS (SELECT k, id, 25 + (75 * n * nn) // ll AS m FROM d, s),
q AS (SELECT id AS item_id, t, count(*) AS times FROM w WHERE kind = 1 GROUP BY ALL),
p AS (SELECT k, t, count(*) AS tf FROM w WHERE kind = 0 AND t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, nn),
sc AS (SELECT item_id, id AS doc_id, k, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN df USING (t) JOIN dm USING (k) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM sc WHERE score > 0) WHERE rank <= 10""",
}
