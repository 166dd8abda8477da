"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import approx, disclosure, hyphen, perturb
from ..functions import text as T
from ..functions.lexicons import DIMENSIONS
from ..operators import language, names, splits
from ..operators import sentiment as S
from .adapters import PROBE, TOKENS, hits, per_hundred, phrases, posts, rounded, words
from .catalog import register, table


@register("clean_text_fields", r"""
WITH a AS (SELECT page_id, regexp_replace(coalesce(url, '') || chr(10) || chr(10) || coalesce(html, ''), '^\s+|\s+$', '', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '\[([^\]]+)\]\(([^)]+)\)', '\1', 'g') AS t FROM b),
d AS (SELECT page_id, regexp_replace(t, 'https?://\S+|www\.\S+', ' [URL] ', 'g') AS t FROM c),
e AS (SELECT page_id, regexp_replace(t, '(?im)^\*?I am a bot.*$|^\*?This action was performed automatically.*$', '', 'g') AS t FROM d),
f AS (SELECT page_id, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g') AS t FROM e)
SELECT page_id, md5(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS digest FROM f""")
def clean_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_text(F.col("url"), F.col("html"))).alias("digest"))


REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 'https?://\S+|www\.\S+', ' [URL] ', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', ' [EMAIL] ', 'g'),
 '\b(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{2,4}\)?[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}\b', ' [PHONE] ', 'g'), '\b(?:/u/|u/)[A-Za-z0-9_-]+\b', ' [USER] ', 'g'),
 '\b/?r/[A-Za-z0-9_-]+\b', ' [SUB] ', 'g'), '(^|[^A-Za-z0-9])@[A-Za-z0-9_]{2,}\b', '\1 [HANDLE] ', 'g')"""


@register("redact_pii", f"WITH r AS (SELECT doc_id, {REDACT} AS t FROM documents) SELECT doc_id, md5(t) AS digest, CAST((length(t) - length(replace(t, '[PHONE]', ''))) // 7 AS BIGINT) AS phones FROM r")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), T.occurrences(F.col("t"), "[PHONE]").cast("long").alias("phones"))


@register("author_pseudonym", "SELECT c_custkey, 'u_' || substr(sha256('anxiety-research-v1|' || c_name), 1, 12) AS author_hash FROM customer")
def author_pseudonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.pseudonym(F.col("c_name")).alias("author_hash"))


@register("token_stats", rf"""
WITH t AS (SELECT doc_id, text, {TOKENS} AS toks, list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?]+\s+|\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '') AS sents FROM documents)
SELECT doc_id, CAST(length(text) AS DOUBLE) AS f_n_chars, CAST(len(toks) AS DOUBLE) AS f_n_tokens, CAST(len(sents) AS DOUBLE) AS f_n_sents,
  round(CASE WHEN len(sents) = 0 THEN 0 ELSE len(toks) / len(sents) END, 6) AS f_avg_sent_len, round(CASE WHEN len(toks) = 0 THEN 0 ELSE list_sum(list_transform(toks, lambda x: length(x))) / len(toks) END, 6) AS f_avg_word_len FROM t""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    return rounded(wide.select("doc_id", *[c.alias(n) for n, c in T.feature_columns(F.col("text"), F.col("w"), PROBE, ("length",)).items()]))


@register("lexicon_scores", f"""
WITH t AS (SELECT doc_id, text, {TOKENS} AS toks FROM documents), n AS (SELECT *, greatest(1, len(toks)) AS n FROM t)
SELECT doc_id, round({per_hundred(hits(PROBE.anxiety_terms) + ' + ' + phrases(PROBE.anxiety_phrases))}, 6) AS anxiety,
  round({per_hundred(hits(PROBE.health_terms) + ' + ' + phrases(PROBE.health_phrases) + ' + ' + phrases(PROBE.reassurance) + ' // 2')}, 6) AS health_anxiety,
  round({per_hundred(hits(PROBE.depression_terms))}, 6) AS depression, round({per_hundred(hits(PROBE.suicidality_terms))}, 6) AS suicidality FROM n""")
def lexicon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    return rounded(wide.select("doc_id", *[c.alias(n) for n, c in T.lexicon_scores(F.col("text"), F.col("w"), PROBE).items()]))


def _rate(terms: tuple[str, ...]) -> str:
    return f"round({hits(terms)} / n, 6)"


STYLE_SQL = f"""
WITH t AS (SELECT doc_id, text, {TOKENS} AS toks FROM documents), n AS (SELECT *, CAST(greatest(1, len(toks)) AS DOUBLE) AS n FROM t)
SELECT doc_id, {_rate(PROBE.anxiety_terms)} AS f_anx_term_rate, {phrases(PROBE.anxiety_phrases)} AS f_anx_phrase_count, {_rate(PROBE.health_terms)} AS f_health_anx_term_rate, {phrases(PROBE.health_phrases)} AS f_health_anx_phrase_count,
  {phrases(PROBE.reassurance)} AS f_reassurance_count, {_rate(PROBE.depression_terms)} AS f_dep_term_rate, {_rate(PROBE.suicidality_terms)} AS f_suic_term_rate, {_rate(PROBE.body_parts)} AS f_body_part_rate,
  {_rate(PROBE.first_singular)} AS f_first_sing_rate, {_rate(PROBE.first_plural)} AS f_first_plur_rate, {_rate(PROBE.second_person)} AS f_second_rate, {_rate(PROBE.third_person)} AS f_third_rate,
  round(({hits(PROBE.uncertainty)} + {phrases(PROBE.uncertainty)}) / n, 6) AS f_uncertainty_rate, round(({hits(PROBE.certainty)} + {phrases(PROBE.certainty)}) / n, 6) AS f_certainty_rate,
  round((length(text) - length(replace(text, '?', ''))) / n, 6) AS f_question_rate FROM n"""


@register("style_features", STYLE_SQL)
def style_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    return rounded(wide.select("doc_id", *[c.alias(n) for n, c in T.feature_columns(F.col("text"), F.col("w"), PROBE, ("lexical", "pronoun", "certainty")).items()]))


PROBE_DIMENSIONS = {"first": ("the", "of the", "in"), "second": ("a", "to-the", "and the"), "third": ("is", "la de", "der")}


def _dimension(terms: tuple[str, ...]) -> str:
    plain = tuple(t for t in terms if " " not in t and "-" not in t)
    rest = sorted(set(terms) - set(plain))
    extra = "".join(f" + (length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)}" for t in rest)
    return f"round(({hits(plain)}{extra}) / CAST(greatest(1, len(toks)) AS DOUBLE), 6)"


@register("dimension_rates", "WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z'']+') AS toks FROM documents) SELECT doc_id, " + ", ".join(f"{_dimension(v)} AS {k}" for k, v in PROBE_DIMENSIONS.items()) + " FROM t")
def dimension_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "documents").select("doc_id", "text", T.dimension_tokens(F.col("text")).alias("w"))
    return rounded(wide.select("doc_id", *[c.alias(n) for n, c in T.dimension_rates(F.col("text"), F.col("w"), PROBE_DIMENSIONS).items()]))


@register("clinical_dimension_rates")
def clinical_dimension_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", T.dimension_tokens(F.col("text")).alias("w"))
    return rounded(wide.select("conv_id", "turn", *[c.alias(n) for n, c in T.dimension_rates(F.col("text"), F.col("w"), DIMENSIONS).items()]))


#: Sentences with self-reports, made from ids in both engines.
REPORTS = """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'I am a ' || (15 + c_custkey % 60) || ' year old man from ' || c_mktsegment WHEN 1 THEN 'hello, ' || (13 + c_custkey % 80) || 'F here' WHEN 2 THEN 'as a woman I think so'
 WHEN 3 THEN 'I''m a guy, ' || (c_custkey % 100) || ' yo' WHEN 4 THEN 'm 25 and my friend is 30f' WHEN 5 THEN 'i am ' || (c_custkey % 120) WHEN 6 THEN c_name ELSE 'I am a lady and as a dude' END AS t FROM customer"""


@register("self_reported_attrs", rf"""
WITH r AS ({REPORTS}),
g AS (SELECT id, t, list_distinct(list_filter(list_concat(list_transform(list_concat(regexp_extract_all(t, '(?i)\b(\d{{2}})\s?([mf])\b|\b([mf])\s?(\d{{2}})\b', 2), regexp_extract_all(t, '(?i)\b(\d{{2}})\s?([mf])\b|\b([mf])\s?(\d{{2}})\b', 3)), lambda x: upper(x)),
   list_transform(regexp_extract_all(t, '(?i)\b(?:i am|i''?m|as)\s+a\s+(?:\d{{1,2}}\s+year[- ]old\s+)?(man|woman|male|female|guy|girl|dude|lady)\b', 1), lambda x: CASE WHEN lower(x) IN ('man', 'male', 'guy', 'dude') THEN 'M' ELSE 'F' END)), lambda x: x <> '')) AS gs,
   list_filter(list_transform(list_filter(list_concat(list_transform(regexp_extract_all(t, '(?i)\b\d{{2}}\s?[mf]\b|\b[mf]\s?\d{{2}}\b'), lambda x: regexp_extract(x, '\d+')), list_transform(regexp_extract_all(t, '(?i)\b\d{{1,2}}\s?(?:years?[- ]old|yo|y/o)\b|\b(?:i am|i''?m)\s+\d{{1,2}}\b'), lambda x: regexp_extract(x, '\d+'))), lambda x: x <> ''), lambda x: CAST(x AS BIGINT)), lambda a: a BETWEEN 13 AND 99) AS ages FROM r)
SELECT id, CASE WHEN len(gs) = 1 THEN gs[1] END AS gender, CAST(ages[1] AS BIGINT) AS age, CASE WHEN ages[1] < 25 THEN '<25' WHEN ages[1] < 35 THEN '25-34' WHEN ages[1] IS NOT NULL THEN '35+' END AS band FROM g""")
def self_reported_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("sedgewren_customer")
    r = spark.sql(REPORTS.replace("FROM customer", "FROM sedgewren_customer").replace("'I''m", r"'I\'m"))
    wide = r.select("id", T.self_reported_gender(F.col("t")).alias("gender"), T.self_reported_age(F.col("t")).cast("long").alias("age"))
    return wide.withColumn("band", T.age_band(F.col("age")))


MASK = ("the", "of the", "and", "la", "der")


@register("lexicon_mask", r"""WITH a AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS text FROM documents) SELECT doc_id, md5(regexp_replace(text, '(?i)of the|\bthe\b|\band\b|\bder\b|\bla\b', ' ', 'g')) AS digest, CAST(len(regexp_extract_all(lower(text), 'of the|\bthe\b|\band\b|\bder\b|\bla\b')) AS BIGINT) AS n FROM a""")
def lexicon_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    # SQL's word boundary knows ASCII alone, so both sides look at ASCII.
    a = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "").alias("text"))
    return a.select("doc_id", F.md5(T.mask_terms(F.col("text"), MASK)).alias("digest"), T.count_terms(F.col("text"), MASK).cast("long").alias("n"))


@register("scalar_transforms", r"""
WITH s AS (SELECT doc_id, ((doc_id * 7919) % 1000) / 1000 AS s FROM documents), c AS (SELECT *, least(greatest(s, 0.000001::DOUBLE), 0.999999::DOUBLE) AS p FROM s)
SELECT doc_id, CAST(s >= 0.5 AS BIGINT) AS bin, CAST(CAST(s >= 0.1::DOUBLE AS INT) + CAST(s >= 0.3::DOUBLE AS INT) + CAST(s >= 0.5::DOUBLE AS INT) AS BIGINT) AS level, CAST(CASE WHEN s <= 0.2::DOUBLE THEN 0 WHEN s >= 0.8::DOUBLE THEN 1 ELSE -1 END AS BIGINT) AS vote,
 round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-s)), 6) AS sig FROM c""")
def scalar_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = posts(spark, sf_dir).select("doc_id", F.col("score").alias("s"))
    return rounded(s.select("doc_id", T.binarise(F.col("s")).alias("bin"), T.level(F.col("s")).alias("level"), T.vote(F.col("s"), 0.8, 0.2).alias("vote"), T.logit(F.col("s")).alias("logit"), T.sigmoid(F.col("s")).alias("sig")))


@register("answer_parsing", r"""
WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'Yes, surely not no' WHEN 1 THEN 'no. yes' WHEN 2 THEN '```json {"label": ' || c_nationkey || '}```' WHEN 3 THEN 'yesterday nothing' ELSE c_name END AS t FROM customer),
b AS (SELECT *, lower(t) AS l, length(regexp_extract(lower(t), '(?s)^(.*?)\byes\b', 1)) AS py, length(regexp_extract(lower(t), '(?s)^(.*?)\bno\b', 1)) AS pn, regexp_matches(lower(t), '\byes\b') AS hy, regexp_matches(lower(t), '\bno\b') AS hn FROM a)
SELECT id, CAST(CASE WHEN hy AND (NOT hn OR py < pn) THEN 1 WHEN hn THEN 0 END AS BIGINT) AS verdict, CAST(TRY_CAST(regexp_extract(t, '(?s)\{.*\}', 0) AS JSON) ->> '$.label' AS BIGINT) AS label, substr(regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS slug FROM b""")
def answer_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 5
    t = F.when(k == 0, "Yes, surely not no").when(k == 1, "no. yes").when(k == 2, F.concat(F.lit('```json {"label": '), F.col("c_nationkey").cast("string"), F.lit("}```"))).when(k == 3, "yesterday nothing").otherwise(F.col("c_name"))
    a = c.select(F.col("c_custkey").alias("id"), t.alias("t"))
    return a.select("id", T.verdict(F.col("t")).cast("long").alias("verdict"), F.from_json(T.first_object(F.col("t")), "label long")["label"].alias("label"), T.slug(F.col("t")).alias("slug"))


def language_sql(toks: str) -> str:
    n = {code: f"len(list_filter({toks}, lambda x: list_contains({words(sorted(set(stop)))}, x)))" for code, stop in approx.STOP_WORDS.items()}
    most = f"greatest({', '.join(n.values())})"
    return "CASE " + " ".join(f"WHEN {n[c]} = {most} THEN '{c}'" for c in ("en", *sorted(set(n) - {"en"}, reverse=True))) + " END"


@register("language_approx", f"SELECT lang, found, count(*) AS n FROM (SELECT lang, {language_sql('toks')} AS found FROM (SELECT lang, {TOKENS} AS toks FROM documents)) GROUP BY lang, found")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", approx.language_approx(F.col("text")).alias("found"))
    return d.groupBy("lang", "found").agg(F.count("*").alias("n"))


VOWELS = "len(regexp_extract_all(w, '[aeiouyäöüéèêáíóú]+'))"
READABILITY_SQL = rf"""
WITH t AS (SELECT doc_id, text, {TOKENS} AS toks, len(list_filter(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '[.!?]+\s+|\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS sents FROM documents),
n AS (SELECT doc_id, text, len(toks) / greatest(1, sents) AS per_sentence, greatest(1, len(toks)) AS n, coalesce(list_sum(list_transform(toks, lambda w: greatest(1, {VOWELS}))), 0) AS syllables, len(list_filter(toks, lambda w: {VOWELS} >= 3)) AS hard FROM t)
SELECT doc_id, CASE WHEN length(text) < 20 THEN 0 ELSE round(206.835::DOUBLE - 1.015::DOUBLE * per_sentence - 84.6::DOUBLE * (syllables / n), 4) END AS f_flesch_approx,
       CASE WHEN length(text) < 20 THEN 0 ELSE round(0.4::DOUBLE * (per_sentence + 100::DOUBLE * (hard / n)), 4) END AS f_gunning_fog_approx,
       0::DOUBLE AS f_sent_compound, 0::DOUBLE AS f_sent_pos, 0::DOUBLE AS f_sent_neg, 0::DOUBLE AS f_sent_neu FROM n"""


@register("readability_approx", READABILITY_SQL)
def readability_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = T.once(table(spark, sf_dir, "documents").select("doc_id", "text"), w=T.tokens(F.col("text")))
    wide = T.once(wide, v=T.vowel_groups(F.col("w")), s=F.size(T.sentences(F.col("text"))))
    return rounded(wide.select("doc_id", *[c.alias(n) for n, c in T.feature_columns(F.col("text"), F.col("w"), PROBE, ("readability", "sentiment"), F.col("v"), F.col("s")).items()]), 4)


#: Letters n-gram by n-gram, with a space at both ends of a word; shares of the 3,000 most frequent ones of each language.
PROFILES_SQL = r"""
WITH d AS (SELECT doc_id, lang, text, CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) / 4294967296 >= 0.5 AS held_out FROM documents),
ok AS (SELECT lang FROM d WHERE NOT held_out AND text IS NOT NULL AND lang IS NOT NULL GROUP BY lang HAVING count(*) >= 3),
w AS MATERIALIZED (SELECT doc_id, lang, held_out, ' ' || word || ' ' AS word, count(*) AS n FROM (SELECT doc_id, lang, held_out, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM d) GROUP BY ALL),
v AS MATERIALIZED (SELECT word, substr(word, CAST(i AS INT), CAST(k AS INT)) AS g FROM (SELECT DISTINCT word FROM w) AS x, range(1, 4) AS r(k), LATERAL (SELECT unnest(range(1, length(word) - k + 2)) AS i)),
c AS (SELECT lang, g, sum(n) AS n FROM w JOIN v USING (word) JOIN ok USING (lang) WHERE NOT held_out GROUP BY lang, g),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, encode(g)) AS r FROM c) WHERE r <= 3000),
s AS (SELECT lang, sum(n) AS total, (SELECT count(DISTINCT g) FROM t) AS size FROM t GROUP BY lang),
p AS (SELECT g, s.lang, ln((coalesce(t.n, 0) + 0.5) / (total + 0.5 * (size + 1))) AS share FROM (SELECT DISTINCT g FROM t) JOIN s ON true LEFT JOIN t USING (g, lang)),
e AS (SELECT word, s.lang, sum(coalesce(p.share, ln(0.5 / (total + 0.5 * (size + 1))))) AS weight FROM v JOIN s ON true LEFT JOIN p ON v.g = p.g AND s.lang = p.lang GROUP BY word, s.lang),
f AS (SELECT doc_id, e.lang, round(sum(n * weight), 6) AS total FROM w JOIN e USING (word) GROUP BY doc_id, e.lang),
b AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, lang <> 'en', encode(lang)) AS r FROM f) WHERE r = 1)
SELECT d.doc_id, d.lang, d.held_out, coalesce(b.lang, 'en') AS found FROM d LEFT JOIN b USING (doc_id)
"""


@register("language_profiles", PROFILES_SQL)
def language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text by profiles that were fitted on the half of the rows that is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn("held_out", splits.unit_hash(F.col("doc_id"), 42) >= 0.5)
    profiles = language.fit_profiles(docs.where("not held_out"), "doc_id", "text", "lang", rows=1_000_000)
    return docs.select("doc_id", "lang", "held_out", language.language_by_profile(F.col("text"), profiles).alias("found"))


@register("encoding_round_trip", "SELECT doc_id, md5(coalesce(text, '')) AS once, md5(coalesce(text, '')) AS twice, md5(coalesce(text, '') || ' / ' || coalesce(text, '')) AS mixed FROM documents")
def encoding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were misread once, twice, or in part only, repaired: they equal the texts as they are."""
    misread = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", misread(text).alias("once"), misread(misread(text)).alias("twice"), F.concat(text, F.lit(" / "), misread(text)).alias("mixed"))
    return rows.select("doc_id", *[F.md5(approx.fix_encoding_approx(F.col(c))).alias(c) for c in ("once", "twice", "mixed")])


@register("encoding_repair_approx")
def encoding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(approx.fix_encoding_approx(F.col("text"))).alias("digest"))


SENTENCES = ("I was diagnosed with GAD last year", "I'm not diagnosed with anxiety", "my sister has depression", "I have panic disorder", "I think I have health anxiety", "i am clinically depressed", "Nothing to say here")


@register("disclosure_detector", r"""
WITH s AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer) SELECT id, CAST(k IN (0, 3) AS BIGINT) AS disclosure_anxiety, CAST(0 AS BIGINT) AS disclosure_health_anxiety, CAST(k = 5 AS BIGINT) AS disclosure_depression,
 CASE k WHEN 0 THEN 'I was diagnosed with GAD' WHEN 3 THEN 'I have panic disorder' END AS anxiety_match FROM s""")
def disclosure_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(F.array(*map(F.lit, SENTENCES)), (F.col("c_custkey") % 7).cast("int")).alias("t"))
    found = disclosure.disclosure_labels(s, "t", ("anxiety", "health_anxiety", "depression"))
    return found.select("id", "disclosure_anxiety", "disclosure_health_anxiety", "disclosure_depression", F.col("disclosure_anxiety_match").alias("anxiety_match"))


@register("disclosure_on_documents")
def disclosure_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.disclosure_labels(table(spark, sf_dir, "documents"), "text")
    return found.groupBy("source").agg(*[F.sum(f"disclosure_{t}").alias(f"n_{t}") for t in disclosure.POSITIVE], F.count("*").alias("n"))


@register("punct_strip", r"SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}\s]', '', 'g')) AS digest FROM documents")
def punct_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(perturb.punct_strip(F.col("text"))).alias("digest"))


def perturbed_sql(name: str, text: str = "text", key: str = "doc_id", p: float = 0.15, seed: int = 42) -> str:
    """A perturbed text; a word is held with its place and digest in a struct."""
    if name == "punct_strip":
        return rf"regexp_replace({text}, '[^\p{{L}}\p{{M}}\p{{Nl}}\p{{N}}\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')"
    number = lambda at: f"(CAST('0x' || substr(x.d, {at}, 8) AS BIGINT) / 4294967296.0::DOUBLE)"
    place = lambda n, at=9: f"CAST(floor({number(at)} * {n}) AS INT)"
    char = lambda i: f"substr(x.w, {i} + 1, 1)"
    splice = lambda i, new, gone=1: f"substr(x.w, 1, {i}) || {new} || substr(x.w, {i} + {gone + 1})"
    upper = lambda c: f"({c} = upper({c}) AND {c} <> lower({c}))"
    whole = place("length(x.w)")
    if name == "char_swap":
        i, least = place("(length(x.w) - 1)"), 4
        edit = splice(i, f"{char(f'({i} + 1)')} || {char(i)}", 2)
    elif name == "char_delete":
        edit, least = splice(whole, "''"), 4
    elif name == "keyboard_typo":
        keys = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in perturb.NEIGHBOURS.items()) + "}"
        near = f"{keys}[lower({char(whole)})]"
        new = f"substr({near}, {place(f'length({near})', 17)} + 1, 1)"
        edit, least = f"CASE WHEN {near} IS NULL THEN x.w ELSE {splice(whole, f'CASE WHEN {upper(char(whole))} THEN upper({new}) ELSE {new} END')} END", 4
    elif name == "social_elongate":
        vowels = "list_filter(range(0, length(x.w)), lambda j: contains('aeiou', lower(substr(x.w, CAST(j AS INT) + 1, 1))))"
        i = f"CAST({vowels}[{place(f'len({vowels})')} + 1] AS INT)"
        edit, least = f"CASE WHEN len({vowels}) = 0 THEN x.w ELSE {splice(i, f'repeat({char(i)}, 2 + {place(2, 17)})')} END", 2
    else:
        other = f"CASE WHEN {upper('c')} THEN lower(c) ELSE upper(c) END"
        edit, least = f"array_to_string(list_transform(string_split(x.w, ''), lambda c: CASE WHEN c = 'ß' THEN c ELSE {other} END), '')", 1
    listed = rf"list_filter(regexp_split_to_array({text}, '{perturb.SPACE}'), lambda w: w <> '')"
    held = f"list_transform({listed}, lambda w, i: {{'w': w, 'd': md5('{seed}|' || {key} || '|' || (i - 1))}})"
    return f"array_to_string(list_transform({held}, lambda x: CASE WHEN length(x.w) >= {least} AND CAST('0x' || substr(x.d, 1, 8) AS BIGINT) < {round(p * (1 << 32))} THEN {edit} ELSE x.w END), ' ')"


@register("perturbations", "SELECT doc_id, " + ", ".join(f"md5({perturbed_sql(n)}) AS {n}" for n in perturb.PERTURBATIONS) + " FROM documents")
def perturbations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return perturb.all_perturbed(d, "text", "doc_id").select("doc_id", *[F.md5(n).alias(n) for n in perturb.PERTURBATIONS])


#: Frequent words with made-up valences, boosters and negations, in the place of a sentiment lexicon.
VALENCES = (("the", 1.5), ("of", -1.2), ("and", -2.0), ("is", 0.9), ("der", 0.8), ("die", -1.1), ("que", -0.6), ("la", 1.9), ("les", 1.3), ("a", 2.2), ("with", -0.4), ("it", 3.1))
BOOSTERS = {"in": 0.293, "to": -0.293, "de": 0.293, "für": -0.293}
NEGATED = ("on", "und", "pour", "with", "for")


def sentiment_sql() -> str:
    """The rules as a chain of tables, a column v0, v1, ... for each step."""
    pairs = ", ".join(f"('{w}', CAST({v} AS DOUBLE))" for w, v in VALENCES)
    marks = S.PUNCTUATION.replace("'", "''")
    word = rf"CASE WHEN length(regexp_replace(w, '^[{marks}]+|[{marks}]+$', '', 'g')) <= 2 THEN w ELSE regexp_replace(w, '^[{marks}]+|[{marks}]+$', '', 'g') END"
    capital = "({0} = upper({0}) AND {0} <> lower({0}))"
    back = ", ".join(f"CASE WHEN i > {k} THEN low[i - {k}] END AS p{k}, CASE WHEN i > {k} THEN coalesce({capital.format(f'ws[i - {k}]')}, false) ELSE false END AS l{k}" for k in (1, 2, 3))
    listed = lambda c, items: f"coalesce({c} IN ({', '.join(repr(x) for x in items)}), false)"
    steps, at = [], 0
    steps.append("s0 AS (SELECT *, v + CASE WHEN mixed AND l0 THEN sign(v) * 0.733 ELSE 0 END AS v0 FROM k)")
    push = "CASE {0} " + " ".join(f"WHEN '{w}' THEN {b}" for w, b in BOOSTERS.items()) + " ELSE 0 END"
    for k in (1, 2, 3):
        here = f"(p{k} IS NOT NULL AND k{k} IS NULL)"
        b = push.format(f"p{k}")
        steps.append(f"s{at + 1} AS (SELECT *, CASE WHEN {here} AND {b} <> 0 THEN v{at} + ({b} + CASE WHEN mixed AND l{k} THEN 0.733 ELSE 0 END) * sign(v{at}) * {S.DAMPED[k - 1]} ELSE v{at} END AS v{at + 1} FROM s{at})")
        at += 1
        no = f"({listed(f'p{k}', NEGATED)} OR coalesce(contains(p{k}, 'n''t'), false))"
        factor = f"CASE WHEN {no} THEN -0.74 ELSE 1 END"
        if k > 1:
            so, doubt = (f"({listed('p1', x)}" + (f" OR {listed('p2', x)}" if k == 3 else "") + ")" for x in (("so", "this"), ("doubt",)))
            factor = f"CASE WHEN {listed(f'p{k}', ('never',))} AND {so} THEN 1.25 WHEN {listed(f'p{k}', ('without',))} AND {doubt} THEN 1 WHEN {no} THEN -0.74 ELSE 1 END"
        steps.append(f"s{at + 1} AS (SELECT *, v{at} * CASE WHEN {here} THEN {factor} ELSE 1 END AS v{at + 1} FROM s{at})")
        at += 1
    return rf"""
WITH lex(token, valence) AS (VALUES {pairs}),
t AS (SELECT doc_id, coalesce(text, '') AS text, list_transform(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''), lambda w: {word}) AS ws FROM documents),
u AS (SELECT doc_id, ws, list_transform(ws, lambda w: lower(w)) AS low, len(list_filter(ws, lambda w: {capital.format('w')})) AS loud,
             least(length(text) - length(replace(text, '!', '')), 4) * 0.292 + CASE WHEN length(text) - length(replace(text, '?', '')) <= 1 THEN 0 WHEN length(text) - length(replace(text, '?', '')) <= 3 THEN (length(text) - length(replace(text, '?', ''))) * 0.18 ELSE 0.96 END AS marks FROM t),
e AS (SELECT doc_id, marks, loud > 0 AND loud < len(ws) AS mixed, coalesce(list_position(low, 'est'), 0) AS but, ws, low, unnest(range(1, len(ws) + 1)) AS i FROM u),
f AS (SELECT doc_id, marks, mixed, but, i, low[i] AS token, {capital.format('ws[i]')} AS l0, {back} FROM e),
k AS (SELECT f.*, CASE WHEN token NOT IN ({', '.join(repr(w) for w in BOOSTERS)}) THEN x.valence END AS v, x1.token AS k1, x2.token AS k2, x3.token AS k3
      FROM f LEFT JOIN lex x USING (token) LEFT JOIN lex x1 ON p1 = x1.token LEFT JOIN lex x2 ON p2 = x2.token LEFT JOIN lex x3 ON p3 = x3.token),
{', '.join(steps)},
y AS (SELECT *, v{at} * CASE WHEN {listed('p1', ('least',))} AND k1 IS NULL AND NOT {listed('p2', ('at', 'very'))} THEN -0.74 ELSE 1 END * CASE WHEN but > 0 AND i < but THEN 0.5 WHEN but > 0 AND i > but THEN 1.5 ELSE 1 END AS z FROM s{at}),
a AS (SELECT doc_id, max(marks) AS marks, coalesce(sum(z), 0) AS total, coalesce(sum(CASE WHEN z > 0 THEN z + 1 END), 0) AS up, -coalesce(sum(CASE WHEN z < 0 THEN z - 1 END), 0) AS down, count(CASE WHEN coalesce(z, 0) = 0 THEN 1 END) AS neu, count(z) AS n FROM y GROUP BY doc_id),
b AS (SELECT doc_id, CASE WHEN n > 0 THEN total + sign(total) * marks ELSE 0 END AS total, up + CASE WHEN up > down THEN marks ELSE 0 END AS up, down + CASE WHEN up < down THEN marks ELSE 0 END AS down, neu FROM a)
SELECT d.doc_id, coalesce(round(total / sqrt(total * total + 15), 6), 0) AS compound, coalesce(round(up / nullif(up + down + neu, 0), 6), 0) AS pos, coalesce(round(down / nullif(up + down + neu, 0), 6), 0) AS neg, coalesce(round(neu / nullif(up + down + neu, 0), 6), 0) AS neu FROM documents d LEFT JOIN b USING (doc_id)
"""


@register("sentiment_rules", sentiment_sql())
def sentiment_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    valences = spark.createDataFrame(list(VALENCES), "token string, valence double")
    return rounded(S.sentiment(table(spark, sf_dir, "documents"), "doc_id", "text", valences, BOOSTERS, NEGATED, "est"))


#: Made patterns in the form of hyphenation dictionaries: a gap before a consonant and a vowel, but not within pairs that stand for one sound.
PATTERNS = (
    *[f"1{c}{v}" for c in "bcdfghjklmnpqrstvwxz" for v in "aeiouyäöüéèáíóú"],
    "2th", "t2h", "s2h", "c2h", "q2u", "p2h", "1tion", "4tio", ".un1", ".re1", "ing4", "4ed.", "s3t2r", "n1g", "m1b", "n1d", "l1t", "r1s",
)
EASY = ("und", "the", "definition", "another")


def patterns_sql() -> str:
    """Every pattern at every place of every word; a gap has its greatest weight, odd ones part syllables."""
    rows = []
    for pattern in PATTERNS:
        weights, letters = [0], ""
        for char in pattern:
            if char.isdigit():
                weights[-1] = int(char)
            else:
                letters += char
                weights.append(0)
        rows.append(f"('{letters}', {weights})")
    easy = ", ".join(f"'{w}'" for w in EASY)
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, text, {TOKENS} AS toks, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '[.!?]+\s+|\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> '')) AS sents FROM documents),
t AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS word FROM d) GROUP BY ALL),
w AS MATERIALIZED (SELECT DISTINCT word, '.' || word || '.' AS whole FROM t),
p(letters, weights) AS (VALUES {', '.join(rows)}),
s AS (SELECT word, whole, unnest(range(1, length(whole) + 1)) AS i FROM w),
m AS (SELECT word, i, weights FROM s JOIN (SELECT DISTINCT length(letters) AS k FROM p) ON true JOIN p ON letters = substr(whole, CAST(i AS INT), CAST(k AS INT)) AND length(letters) = k),
g AS (SELECT word, i - 1 + j AS gap, max(weights[CAST(j AS INT) + 1]) AS weight FROM m, range(0, 10) AS r(j) WHERE j < len(weights) GROUP BY ALL),
y AS (SELECT w.word, 1 + count(CASE WHEN weight % 2 = 1 AND gap - 1 >= 2 AND gap - 1 <= length(w.word) - 2 THEN 1 END) AS n FROM w LEFT JOIN g ON w.word = g.word GROUP BY w.word),
a AS (SELECT doc_id, sum(t.n * y.n) AS syllables, sum(CASE WHEN y.n >= 3 AND word NOT IN ({easy}) THEN t.n ELSE 0 END) AS hard FROM t JOIN y USING (word) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(syllables, 0) AS BIGINT) AS syllables, CAST(coalesce(hard, 0) AS BIGINT) AS hard,
       CASE WHEN length(coalesce(text, '')) < 20 OR coalesce(len(toks), 0) = 0 THEN 0 ELSE round(206.835::DOUBLE - 1.015::DOUBLE * (len(toks) / greatest(1, sents)) - 84.6::DOUBLE * syllables / len(toks), 4) END AS f_flesch,
       CASE WHEN length(coalesce(text, '')) < 20 OR coalesce(len(toks), 0) = 0 THEN 0 ELSE round(0.4::DOUBLE * (len(toks) / greatest(1, sents) + 100::DOUBLE * hard / len(toks)), 4) END AS f_gunning_fog
FROM d LEFT JOIN a USING (doc_id)
"""


@register("readability_patterns", patterns_sql())
def readability_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = hyphen.read_patterns(PATTERNS)
    wide = T.once(table(spark, sf_dir, "documents").select("doc_id", "text"), w=T.tokens(F.col("text"))).withColumn("s", hyphen.syllable_counts(F.col("w"), patterns, EASY))
    return rounded(wide.select("doc_id", F.col("s.n").alias("syllables"), F.col("s.hard").alias("hard"), *[c.alias(n) for n, c in hyphen.readability(F.col("text"), F.col("w"), F.col("s")).items()]), 4)


@register("names_redacted")
def names_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in whole texts by the default labeller: how many of each kind, and what is left."""
    t = table(spark, sf_dir, "documents").select("doc_id", names.redact_names(F.col("text"), names.default_tagger()).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), *[T.occurrences(F.col("t"), f"[{tag}]").cast("long").alias(f"n_{tag.lower()}") for tag in names.TAGS[1:]])
