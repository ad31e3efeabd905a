"""The operators' queries over their whole tables, with the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, html_template, jaccard, mixing, packing, quality, topk, toxicity, url_rules
from .store import table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings")
    finite = F.filter("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.when(F.size(finite) == 0, F.transform("embedding", lambda v: F.floor(v.cast("double") * 256).cast("long")))
    vectors = topk.clean(x, "vec_id", whole)
    return topk.top_k(vectors, F.col("__id") % 50 == 0, 5)


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "mix_epoch", "mix_block", "mix_at", "mix_weight")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.apply(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = doc_id) AS component_id FROM s
"""

OP6_SQL = r"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS no, count(*) OVER () AS n FROM documents),
f AS (SELECT a.no, a.doc_id, a.t, b.no AS follow, left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS edited
      FROM o a JOIN o b ON b.no = a.no % a.n + 1),
u AS (SELECT no, 0 AS edit, regexp_extract_all(hex(encode(t)), '..') AS x FROM f UNION ALL SELECT no, 1, regexp_extract_all(hex(encode(edited)), '..') FROM f),
b AS (SELECT no, edit, len(x) AS size, list_transform(x, lambda v: ('0x' || v)::UBIGINT) AS x FROM u),
w AS (SELECT no, edit, unnest(x) AS v, unnest(x[2:]) AS w, unnest(x[3:]) AS x, unnest(x[4:]) AS y, unnest(x[5:]) AS z FROM b WHERE len(x) > 4),
h AS (SELECT no, edit, unnest([v + w * 256 + x * 65536, v + w * 256 + y * 65536 + 16777216, v + x * 256 + y * 65536 + 33554432, v + w * 256 + z * 65536 + 50331648,
                               v + x * 256 + z * 65536 + 67108864, v + y * 256 + z * 65536 + 83886080]) * 2654435761 % 4294967296 AS h FROM w WHERE z IS NOT NULL),
c AS (SELECT no, edit, ((xor(h, h >> 15) * 2246822519 % 4294967296) >> 24)::INTEGER AS bucket, count(*) AS c FROM h GROUP BY ALL),
l AS (SELECT b.no, b.edit, any_value(b.size) AS size, list(coalesce(c.c, 0) ORDER BY g.bucket) AS c
      FROM b CROSS JOIN (SELECT unnest(range(256))::INTEGER AS bucket) g LEFT JOIN c ON c.no = b.no AND c.edit = b.edit AND c.bucket = g.bucket GROUP BY b.no, b.edit),
q AS (SELECT *, list_sort(c)[64] AS q1, list_sort(c)[128] AS q2, list_sort(c)[192] AS q3 FROM l),
d AS (SELECT no, edit, least(255, round(8 * log2(size + 1)))::INTEGER AS len, (q1 * 15 // greatest(q3, 1))::INTEGER AS r1, (q2 * 15 // greatest(q3, 1))::INTEGER AS r2,
             list_transform(c, lambda v: (v > q1)::INTEGER + (v > q2)::INTEGER + (v > q3)::INTEGER) AS l FROM q),
p AS (SELECT *, lower(format('{:02x}{:x}{:x}', len, r1, r2) || array_to_string(list_transform(range(1, 256, 4),
             lambda i: format('{:02x}', l[i] * 64 + l[i + 1] * 16 + l[i + 2] * 4 + l[i + 3])), '')) AS digest FROM d),
m AS (SELECT a.no, a.edit, b.no AS bt, b.edit AS bedit, 1 - (least(48, abs(a.len - b.len)) + abs(a.r1 - b.r1) + abs(a.r2 - b.r2)
             + list_sum(list_transform(range(1, 257), lambda i: [0, 1, 2, 6][abs(a.l[i] - b.l[i]) + 1]))) / 1614.0::DOUBLE AS near
      FROM f JOIN p a ON a.no = f.no AND a.edit = 0 JOIN p b ON b.no = f.no AND b.edit = 1 OR b.no = f.follow AND b.edit = 0)
SELECT f.doc_id, length(f.t) AS n_chars, sha256(f.edited) AS edited_sha256, a.digest AS fingerprint, b.digest AS edited_fingerprint,
       e.near AS near_edited, x.near AS near_next
FROM f JOIN p a ON a.no = f.no AND a.edit = 0 JOIN p b ON b.no = f.no AND b.edit = 1
JOIN m e ON e.no = f.no AND e.bt = f.no AND e.bedit = 1 JOIN m x ON x.no = f.no AND x.bt = f.follow AND x.bedit = 0
"""


OP7_RULES = [
    url_rules.prefix_rule("allow", "org", "/"),
    url_rules.prefix_rule("block", "example.org", "/es/"),
    url_rules.prefix_rule("block", "example.org", "/en/1"),
    url_rules.prefix_rule("allow", "com", "/fr/"),
    url_rules.prefix_rule("block", "com", "/de/"),
]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, OP7_RULES).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (SELECT page_id, url, position('://' IN coalesce(url, '')) AS sep FROM pages),
h AS (SELECT page_id,
             CASE WHEN sep > 0 THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN sep > 0 THEN regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
      FROM p),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT h.page_id, host, path, rule,
       coalesce(v, CASE WHEN regexp_matches(host || path, '^([^/?#]*[.-])?(casino|free[.-]bets|cheap[.-]pills|adult|spam|ads)([.:/-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer()).drop("ids")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    return chat.chat_digests(chat.format_chats(rows))


def _op9_sql() -> str:
    text = "replace(coalesce(text, ''), '\\', '\\\\')"
    for mark in chat.INST.controls:
        text = f"replace({text}, '{mark}', '{mark[0]}\\-{mark[1:]}')"
    marks = " ".join(f"WHEN '{r}' THEN {len(t.before + t.after)}" for r, t in chat.INST.turns.items())
    follows = " OR ".join(f"(coalesce(before, '') = '{a}' AND role = '{b}')" for a, bs in chat.INST.follows.items() for b in bs)
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, lag(role) OVER w AS before, lead(role) OVER w IS NULL AND role = 'assistant' AS done, length({text}) + CASE role {marks} END AS formatted
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(formatted)::BIGINT AS formatted_chars,
       bool_and({follows}) AND bool_or(done) AS valid
FROM t GROUP BY conv_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out())
    return quality.apply(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_mixing": op2_mixing,
    "op3_html": op3_html,
    "op4_toxicity": op4_toxicity,
    "op5_jaccard": op5_jaccard,
    "op6_fingerprint": op6_fingerprint,
    "op7_url_rules": op7_url_rules,
    "op8_packing": op8_packing,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {"op1_topk": OP1_SQL, "op5_jaccard": OP5_SQL, "op6_fingerprint": OP6_SQL, "op7_url_rules": OP7_SQL, "op9_chat": _op9_sql()}
