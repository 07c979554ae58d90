"""The llm queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from chatframe.llm import alignment, audio, cover_tree, html_text, language_id, manifest, mixing, ngram_join, packing, slack_packing, token_counts, toxicity, url_rules
from chatframe.llm.common import doc_bucket, shared_dir, table


def op1_language_id(spark, sf_dir):
    return language_id.predict_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op2_best_fit_packing(spark, sf_dir):
    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), *files, capacity=2048, end_id=0)


def op3_telephony_audio(spark, sf_dir):
    return audio.media_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_pcm=True)


def op4_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_cover_tree(spark, sf_dir):
    return cover_tree.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark, sf_dir):
    """All documents, over a cache of this run that already holds part of the counts, as after an
    earlier load: texts whose hash ends in three zero bits are counted first, and the count of all
    documents finds them stored."""
    cache, path = f"{shared_dir(spark)}/chatframe-token-cache-{uuid.uuid4().hex}", public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_counts.count_tokens(docs.where(F.xxhash64("text").bitwiseAND(7) == 0), path, cache, drops_space=True)
    return token_counts.count_tokens(docs, path, cache, drops_space=True)


def op9_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


def op10_url_filters(spark, sf_dir):
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark, sf_dir):
    files = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), *files, digest=True).withColumnRenamed("groups", "groups_sha256")


def op12_merkle_manifest(spark, sf_dir):
    """All documents' leaves and proofs; a seventh of the documents is verified with one sign more in
    n_chars, as after tampering."""
    docs, columns = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    tampered = manifest.leaf_digest(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns))
    proved = manifest.manifest(docs, columns, tree_col="lang", id_col="doc_id", given=F.when(doc_bucket("doc_id", 7) == 0, tampered))
    found = manifest.folded(proved.withColumn("given", F.coalesce("given", "leaf")), "given")
    digests = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")}
    return found.select("doc_id", *(d.alias(c) for c, d in digests.items()), F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_slack_packing(spark, sf_dir):
    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    packed = slack_packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), *files, capacity=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _op7_sql() -> str:
    """One search for a threshold after the other, each over the documents no larger than what is left."""
    sql = r"""
WITH t AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
d AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 8))::BIGINT AS h FROM t),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST)) AS n FROM s),
c AS (SELECT *, ((n - 1) % 3 + 1)::BIGINT AS weight, (3 * source_size) / ((n - 1) % 3 + 1)::DOUBLE AS cap FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY cap, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / (sum(weight) OVER (ORDER BY cap, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM c),
f AS (SELECT lvl FROM l WHERE lvl <= cap ORDER BY cap, n LIMIT 1),
g AS (SELECT l.*, least((3 * source_size)::DOUBLE, f.lvl * weight) AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS repeats FROM g),
p0 AS (SELECT source, 0::BIGINT AS start, target - repeats * source_size AS rest, 9223372036854775807 AS most FROM r)"""
    for k in range(1, mixing.PASSES + 1):
        nearer = " + CASE WHEN upto - rest < rest - (upto - words) THEN 1 ELSE 0 END" if k == mixing.PASSES else ""
        sql += f""",
k{k} AS (SELECT d.source, h, sum(size)::BIGINT AS words FROM d JOIN p{k - 1} p ON d.source IS NOT DISTINCT FROM p.source WHERE rest > 0 AND h >= start AND size <= most GROUP BY d.source, h),
u{k} AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto FROM k{k}),
c{k} AS (SELECT u.source, min(h) AS h, min(upto) AS upto, arg_min(words, h) AS words FROM u{k} u JOIN p{k - 1} p ON u.source IS NOT DISTINCT FROM p.source WHERE upto > rest GROUP BY u.source),
p{k} AS (SELECT p.source, CASE WHEN rest > 0 THEN coalesce(h{nearer}, 4294967296) ELSE start END AS start, rest - coalesce(upto - words, 0) AS rest, floor(rest - coalesce(upto - words, 0))::BIGINT AS most
         FROM p{k - 1} p LEFT JOIN c{k} c ON p.source IS NOT DISTINCT FROM c.source)"""
    taken = " OR ".join(f"d.h >= p{k - 1}.start AND d.h < p{k}.start AND d.size <= p{k - 1}.most" for k in range(1, mixing.PASSES + 1))
    joins = " ".join(f"JOIN p{k} ON d.source IS NOT DISTINCT FROM p{k}.source" for k in range(mixing.PASSES + 1))
    return sql + f"""
SELECT d.doc_id, d.size, r.source_size, r.target, (d.size * (r.repeats + CASE WHEN {taken} THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source {joins}"""


OP7_SQL = _op7_sql()

_OWN = [r"(^|[^a-z0-9])(casino|poker|slots|pills|viagra|adult|xxx|porn|warez|torrents)([^a-z0-9]|$)", r"^([^/]*[.])?(free-bets[.]|bets[.]|cheap-.*pills[.]|pharma-.*[.]|adult-|spam-.*[.]|link-farm[.]|ads[.].*/click([^a-z0-9]|$))",
        "(^|[^a-z0-9])payday.*loan", "/adserver/", "/wp-login[.]php$", "/cgi-bin/.*[.]exe$", "/download/.*[.]apk$", "^localhost/"]
OP10_SQL = rf"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, action) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (
  SELECT u.page_id, u.host, u.path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM u JOIN r ON (u.host = rhost OR u.host LIKE '%.' || rhost) AND starts_with(u.path, rpath) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, m.rule,
       CASE WHEN m.rule IS NOT NULL THEN m.action WHEN {" OR ".join(f"regexp_matches(u.host || u.path, '{p}', 'is')" for p in _OWN)} THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN m USING (page_id)
"""

_PARTS = "".join(f" || coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {{}}::VARCHAR, '-')".replace("{}", c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_LEAF = f"sha256(''{_PARTS})"
#: CRC-32 of the id's digits, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT + 256, 0, 0, 0, 0, 0, 0, 0, 0]))), lambda a, e: CASE WHEN e >= 256 THEN xor(a, e - 256) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
#: Both trees by levels: each level's nodes are its pairs' digests. A proof is what stands beside a leaf's
#: path; a path goes through the tree of its language and then through the tree of languages.
OP12_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF} AS leaf, {_LEAF.replace("n_chars", "(n_chars + 1)")} AS other, {_CRC} AS crc FROM documents),
l AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
u AS (SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM l
      UNION ALL SELECT lvl + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, lang, pos // 2, n),
s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM u WHERE n = 1),
v AS (SELECT 0 AS lvl, pos, subroot AS h, n FROM s
      UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM v WHERE n > 1 GROUP BY lvl, pos // 2, n),
r AS (SELECT h AS root FROM v WHERE n = 1),
p AS (SELECT l.id, 0 AS tree, k.lvl, (l.pos >> k.lvl) & 1 AS side, b.h FROM l JOIN (SELECT DISTINCT lang, lvl FROM u WHERE n > 1) k ON l.lang IS NOT DISTINCT FROM k.lang
        LEFT JOIN u b ON b.lang IS NOT DISTINCT FROM l.lang AND b.lvl = k.lvl AND b.pos = xor(l.pos >> k.lvl, 1)
      UNION ALL SELECT l.id, 1, k.lvl, (s.pos >> k.lvl) & 1, b.h FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT lvl FROM v WHERE n > 1) k LEFT JOIN v b ON b.lvl = k.lvl AND b.pos = xor(s.pos >> k.lvl, 1)),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tree, lvl) AS step FROM p),
f AS (SELECT id, 0 AS step, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS h FROM l
      UNION ALL SELECT f.id, o.step, sha256(CASE WHEN o.h IS NULL THEN f.h WHEN o.side = 1 THEN o.h || f.h ELSE f.h || o.h END) FROM f JOIN o ON o.id = f.id AND o.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.subroot, r.root, sha256(coalesce(q.proof, '')) AS proof_sha256, g.h AS folded_root, g.h = r.root AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN r LEFT JOIN (SELECT id, string_agg(h, '' ORDER BY step) AS proof FROM o GROUP BY id) q ON q.id = l.id
JOIN (SELECT id, arg_max(h, step) AS h FROM f GROUP BY id) g ON g.id = l.id"""

QUERIES = {q.__name__: q for q in (op1_language_id, op2_best_fit_packing, op3_telephony_audio, op4_ngram_jaccard_join, op5_cover_tree, op6_toxicity, op7_mixing, op8_token_counts, op9_html_extraction, op10_url_filters, op11_token_alignment, op12_merkle_manifest, op13_slack_packing)}
ORACLES = {"op7_mixing": OP7_SQL, "op10_url_filters": OP10_SQL, "op12_merkle_manifest": OP12_SQL}
