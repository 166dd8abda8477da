"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from . import chat, decontam, embeddings, filter_audit, html_text, merkle, packing, pii, sharding, simhash, suffixes, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    def put(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS n
      FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id AND m.n = 1
"""


@query("op5_url_filter", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
             + {marks} AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(escaped + CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 22 WHEN 'assistant' THEN 4 ELSE 20 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP2_SQL = OP2_SQL.replace("{marks}", " + ".join(f"(length(text) - length(replace(text, '{k}', ''))) // {len(k)}" for k in chat.CONTROLS))


@query("op2_chat", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.format_chats(rows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: All pairs by double-precision cosine; vectors that link with nothing are their own component.
OP1_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT k, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b, a.vec_id AS va, b.vec_id AS vb FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r(k, c) AS (SELECT k, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.k = l.a),
m AS (SELECT k, min(c) AS component_id FROM r GROUP BY k),
n AS (SELECT a AS k, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m USING (k) LEFT JOIN n USING (k)
"""


@query("op1_embeddings", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_dedup(table(spark, sf_dir, "embeddings"))


#: White space as Python knows it; windows of 50 words that two documents have, merged where they meet.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
p AS (SELECT k, doc_id, unnest(regexp_extract_all(text, '[{s}]+|[^{s}]+')) AS part, generate_subscripts(regexp_extract_all(text, '[{s}]+|[^{s}]+'), 1) AS i FROM d),
o AS (SELECT k, doc_id, part, i, sum(length(part)) OVER (PARTITION BY k ORDER BY i) AS till FROM p),
w AS (SELECT k, doc_id, part, row_number() OVER (PARTITION BY k ORDER BY i) AS n, till FROM o WHERE NOT regexp_matches(part, '^[{s}]')),
r AS (SELECT k, doc_id, n, till - length(part) AS s, lead(till, 49) OVER (PARTITION BY k ORDER BY n) AS e,
             string_agg(part, ' ') OVER (PARTITION BY k ORDER BY n ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS run FROM w),
b AS (SELECT run FROM r WHERE e IS NOT NULL GROUP BY run HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT k, doc_id, n, s, e, CASE WHEN n <= lag(n) OVER (PARTITION BY k ORDER BY n) + 50 THEN 0 ELSE 1 END AS new FROM r JOIN b USING (run) WHERE e IS NOT NULL),
g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY n) AS g FROM h)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", CAST(max(n) - min(n) + 50 AS BIGINT) AS n_words FROM g GROUP BY k, doc_id, g
""".replace("{s}", r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


@query("op10_suffixes", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(spread(table(spark, sf_dir, "documents")))


@query("op9_html")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spread(table(spark, sf_dir, "pages")))


def crc_table() -> list[int]:
    """The 256 remainders of CRC-32 (reflected polynomial 0xEDB88320)."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB's SQL."""
    table = f"CAST({crc_table()} AS BIGINT[])"
    step = f"xor(c >> 8, {table}[CAST(xor(c, h) & 255 AS INT) + 1])"
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST(CAST('0x' || h AS INT) AS BIGINT)), lambda c, h: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


#: Two rows of one id, size and checksum are alike, so their order does not matter.
OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
p AS (SELECT *, sum(size) OVER () AS whole, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
s AS (SELECT *, CAST((2 * before + size) * 16 // (2 * whole) AS INT) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM s
"""


@query("op12_sharding", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.assign(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Each order and step counted over documents by itself, not through subsets.
OP13_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
f AS (SELECT w.doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
             count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS gone, substr(filter_order, 1, step) AS applied FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
r AS (SELECT m.part, s.filter_order, s.step, s.filter,
             sum(CASE WHEN translate(m.fails, s.applied, '') = m.fails THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN contains(m.fails, s.filter) AND translate(m.fails, s.gone, '') = m.fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN contains(m.fails, s.filter) AND translate(m.fails, s.gone, '') <> m.fails THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN m.fails = s.filter THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN contains(m.fails, s.filter) AND translate(m.fails, s.gone, '') = m.fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN contains(m.fails, s.filter) AND translate(m.fails, s.gone, '') = m.fails THEN toxic ELSE 0 END) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r
"""


@query("op13_filter_audit", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def merkle_sql() -> str:
    """Levels of all trees by one recursion, and each row's fold by another."""
    field = lambda c, t: f"coalesce(CAST(strlen({t}) AS VARCHAR) || ':' || {t}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join([field("", "CAST(doc_id AS VARCHAR)"), field("", "source"), field("", "lang"), field("", "CAST(n_chars AS VARCHAR)"), field("", text)]) + ")"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} END AS again FROM documents),
t AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d)),
p AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf, again FROM d JOIN t ON d.lang IS NOT DISTINCT FROM t.lang),
n(tree, level, i, node, last) AS (
    SELECT tree, 0, i, leaf, max(i) OVER (PARTITION BY tree) FROM p
    UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), last // 8 FROM n WHERE last > 0 GROUP BY tree, level, i // 8, last),
h AS (SELECT tree, max(level) AS height FROM n GROUP BY tree),
u(level, i, node, last) AS (
    SELECT 0, n.tree, node, (SELECT max(tree) FROM t) FROM n JOIN h ON n.tree = h.tree AND n.level = h.height
    UNION ALL SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), last // 8 FROM u WHERE last > 0 GROUP BY level, i // 8, last),
-- all nodes above a row, those of its tree first, then those above its subroot
a AS (SELECT p.tree, p.i, n.level AS level, n.i AS own, n.tree AS of FROM p JOIN n ON n.tree = p.tree AND n.i = p.i // CAST(pow(8, n.level) AS BIGINT)),
b AS (SELECT tree, i, level, own, of FROM a JOIN h USING (tree) WHERE level < height
      UNION ALL SELECT p.tree, p.i, h.height + u.level, u.i, NULL FROM p JOIN h USING (tree) JOIN u ON u.i = p.tree // CAST(pow(8, u.level) AS BIGINT) WHERE u.last > 0),
s AS (SELECT b.tree, b.i, b.level, coalesce(string_agg(CASE WHEN x.i < b.own THEN x.node END, '' ORDER BY x.i), '') AS l, coalesce(string_agg(CASE WHEN x.i > b.own THEN x.node END, '' ORDER BY x.i), '') AS r
      FROM b JOIN (SELECT tree, level, i, node FROM n UNION ALL SELECT NULL, level, i, node FROM u) x
        ON x.tree IS NOT DISTINCT FROM b.of AND x.level = b.level - CASE WHEN b.of IS NULL THEN (SELECT height FROM h WHERE h.tree = b.tree) ELSE 0 END AND x.i // 8 = b.own // 8
      GROUP BY b.tree, b.i, b.level),
g(tree, i, level, node) AS (SELECT tree, i, 0, coalesce(again, leaf) FROM p UNION ALL SELECT g.tree, g.i, g.level + 1, sha256(l || node || r) FROM g JOIN s ON g.tree = s.tree AND g.i = s.i AND g.level = s.level),
e AS (SELECT tree, i, arg_max(node, level) AS folded_root FROM g GROUP BY tree, i),
q AS (SELECT tree, i, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM s GROUP BY tree, i)
SELECT p.doc_id, p.leaf, (SELECT node FROM u WHERE u.level = 0 AND u.i = p.tree) AS subroot, (SELECT node FROM u WHERE u.last = 0) AS root,
       coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = (SELECT node FROM u WHERE u.last = 0) AS verified
FROM p JOIN e ON p.tree = e.tree AND p.i = e.i LEFT JOIN q ON p.tree = q.tree AND p.i = q.i
"""


@query("op11_merkle", merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_hash("doc_id", "source", "lang", "n_chars", lower))
    leaves = docs.select("doc_id", "lang", merkle.leaf_hash(*merkle.FIELDS).alias("leaf"), changed.alias("changed"))
    proved = merkle.prove(leaves)
    folded = proved.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = F.sha2(F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    return folded.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
