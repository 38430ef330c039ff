"""The registered queries of this folder and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelscope.llm import (byte_bpe, chat_format, conversation_trie, decontaminate, embedding_dedup, jaccard_join, merkle, packing, quality,
                           secret_scan, shard, suffix_dedup, url_filter)
from reelscope.llm.common import read_table

URL_RULES = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"),
             url_filter.Rule("allow", "www.example.com", "/en/"), url_filter.Rule("block", "net", "/es/"),
             url_filter.Rule("block", "net", "/fr/")]
CONTROL_TURN = "</s>[INST] ok [/INST]"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], turns.schema)
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(control)))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shard_documents(read_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, read_table(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model, to="score")
    return out.select("doc_id", (~quality.learnable(F.col("doc_id"))).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_scan.scan_secrets(docs).select("doc_id", F.col("secret_spans").alias("s"))

    def of(kind: str):
        return F.filter("s", lambda s: s["kind"] == kind)

    base = F.filter("s", lambda s: s["kind_no"] < 3)
    return out.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                      F.sha2(secret_scan.told(base).cast("binary"), 256).alias("base_sha256"),
                      secret_scan.told(F.col("s")).alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"), jaccard_join.Likeness(4, 85, 100))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encode, decode = byte_bpe.encoder(spark, ranks, public_tokenizers.PATTERN), byte_bpe.decoder(spark, ranks)
    out = read_table(spark, sf_dir, "documents").select("doc_id", encode("text").alias("ids"))
    out = out.select("doc_id", "ids", decode("ids").alias("decoded"))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_trie.trie_nodes(conversation_trie.forked_paths(turns))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    bent = [F.replace("text", F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in merkle.FIELDS]
    out = merkle.manifest(docs, carry={"tampered": F.when(hit, merkle.leaf_digest(bent))})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.withColumn("folded_root", folded)
    return out.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
                      "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_url_filter, op2_decontaminate, op3_chat_format, op4_shards, op5_quality, op6_secrets,
           op7_suffix_dedup, op8_embedding_dedup, op9_packing, op10_jaccard_join,
           op11_byte_bpe, op12_conversation_trie, op13_merkle]
    return {f.__name__: f for f in own}


SQL_OP1 = r"""
WITH r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
fit AS (SELECT page_id, rhost || rpath AS rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, verdict DESC) AS k
  FROM (SELECT DISTINCT * FROM p) q JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON p.page_id IS NOT DISTINCT FROM f.page_id
"""

SQL_OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, coalesce(lag(role) OVER w <> role, TRUE) AS fresh,
  length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\])', '\1\2\\\3', 'g')) AS n_text,
  length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|INST\]|/INST\])', '\1\2\\\3', 'g')) AS n_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + 10 + CASE WHEN fresh THEN n_role + 12 + 11 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _shingles(table: str, key: str, n: int) -> str:
    """CTEs ``{table}_s`` (key, distinct shingle) and ``{table}_n`` (key, size)."""
    return rf"""{table}_w AS (SELECT {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
{table}_s AS (SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {n}
  THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM {table}_w),
{table}_n AS (SELECT {key}, count(*) AS n FROM {table}_s GROUP BY {key})"""


SQL_OP2 = f"""
WITH {_shingles("documents", "doc_id", 5)}, {_shingles("benchmark", "item_id", 5)},
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM documents_s JOIN benchmark_s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, n_shared, n_shared / n AS containment
FROM shared JOIN benchmark_n USING (item_id) WHERE 100 * n_shared >= 80 * n
"""

SQL_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL
  AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)), FALSE)
  AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
cnt AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN cnt ON vec_id = cnt.a
"""

SQL_OP10 = f"""
WITH RECURSIVE {_shingles("documents", "doc_id", 4)},
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM documents_s x JOIN documents_s y
  ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN documents_n p ON p.doc_id = a JOIN documents_n q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN documents_n n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""


def _crc32(number: str) -> str:
    """CRC-32 of a number's decimal digits, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    digits = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {digits}), lambda c, b: {byte}), 4294967295)"


_LEAF = "sha256(" + " || ".join(
    f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

SQL_OP12 = f"""
WITH own AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM (
  SELECT conv_id AS c, turn, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
cs AS (SELECT DISTINCT c, {_crc32("c")} % 4 AS h, c - c % 20 AS b FROM own),
turns AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM (
  SELECT cs.c, 0 AS part, p, k, w FROM cs JOIN own ON own.c = cs.b AND p <= h
  UNION ALL SELECT cs.c, 1, p, k, w FROM cs JOIN own ON own.c = cs.c AND p > h)),
member AS (SELECT c, 0 AS d, [] AS path, 0 AS w FROM cs UNION ALL
  SELECT c, d, list(k) OVER (PARTITION BY c ORDER BY d), w FROM turns),
ending AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM member),
node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM ending GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids ON kids.path = node.path),
below AS (SELECT path[1:j] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n - 1) * w) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM full_node) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM full_node x JOIN below ON below.path = x.path LEFT JOIN node up ON x.d > 0 AND up.path = x.path[1:x.d - 1]
"""


SQL_OP13 = f"""
WITH RECURSIVE raw AS (SELECT row_number() OVER () AS rid, *, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g FROM documents),
leaves AS (SELECT rid, doc_id, g, {_LEAF.format("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32("doc_id")} % 2 = 0
  THEN {_LEAF.format("replace(text, chr(10), '')")} END AS tampered FROM raw),
base AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
node(g, lvl, pos, h, n) AS (SELECT g, 0, pos, leaf, n FROM base UNION ALL
  SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM node WHERE n > 1 GROUP BY g, lvl, pos // 3, n),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
top(lvl, pos, h, n) AS (SELECT 0, pos, subroot, n FROM sub UNION ALL
  SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
run AS (SELECT g, lvl, pos // 3 AS k, list(h ORDER BY pos) AS hs FROM node WHERE n > 1 GROUP BY ALL),
toprun AS (SELECT lvl, pos // 3 AS k, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
up(rid, g, lvl, pos, acc, proof, n) AS (SELECT rid, g, 0, pos, coalesce(tampered, leaf), '', n FROM base UNION ALL
  SELECT rid, up.g, up.lvl + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3], '') || acc || array_to_string(hs[pos % 3 + 2:], '')),
  proof || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], ''), (n + 2) // 3
  FROM up JOIN run ON run.g = up.g AND run.lvl = up.lvl AND run.k = pos // 3 WHERE n > 1),
over(rid, lvl, pos, acc, proof, n) AS (SELECT rid, 0, sub.pos, acc, proof, sub.n FROM up JOIN sub ON sub.g = up.g WHERE up.n = 1 UNION ALL
  SELECT rid, over.lvl + 1, pos // 3, sha256(array_to_string(hs[1:pos % 3], '') || acc || array_to_string(hs[pos % 3 + 2:], '')),
  proof || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], ''), (n + 2) // 3
  FROM over JOIN toprun ON toprun.lvl = over.lvl AND toprun.k = pos // 3 WHERE n > 1)
SELECT doc_id, leaf, subroot, top.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top.h AS verified
FROM over JOIN base ON base.rid = over.rid JOIN sub ON sub.g = base.g JOIN top ON top.n = 1 WHERE over.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": SQL_OP1, "op2_decontaminate": SQL_OP2, "op3_chat_format": SQL_OP3,
            "op8_embedding_dedup": SQL_OP8, "op10_jaccard_join": SQL_OP10, "op12_conversation_trie": SQL_OP12,
            "op13_merkle": SQL_OP13}
