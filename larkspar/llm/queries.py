"""The registered queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm import bpe, chat, decontaminate, fingerprints, linededup, lm, neardedup, quality, secrets, urls
from larkspar.llm.common import read


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.learn(docs, read(spark, sf_dir, "labels"), learnt=~held_out)
    return quality.classify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), *_vocabulary())


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, read(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS shingle FROM (SELECT item_id, w, least(5, len(w)) AS size, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
shingles AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS shingle FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
lengths AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
SELECT s.doc_id, i.item_id, n_item, count(*) AS n_shared, count(*) / CAST(n_item AS DOUBLE) AS containment
FROM shingles s JOIN items i ON s.size = i.size AND s.shingle = i.shingle JOIN lengths l ON i.item_id = l.item_id
GROUP BY s.doc_id, i.item_id, n_item HAVING count(*) * 5 >= n_item * 4
"""


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    return lm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), train)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = chat.read_back(chat.format_turns(chat.turn_rows(rows.unionByName(more))))
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _op7_sql() -> str:
    def escaped(x: str) -> str:
        out = f"replace({x}, '{chat.MARK}', '{chat.MARK}0')"
        for control, code in chat.CONTROLS.items():
            out = f"replace({out}, '{control}', '{chat.MARK}{code}')"
        return out

    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({len(chat.START) + len(chat.END) + 2} + length({escaped("role")}) + length({escaped("text")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split),
frequent AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE f.k IS NOT NULL AND doc_id <> top) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (f.k IS NOT NULL AND doc_id <> top)), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
GROUP BY doc_id
"""

def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardedup.link(read(spark, sf_dir, "documents"), size=2)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, b AS u FROM edges UNION SELECT r.v, e.b FROM reach r JOIN edges e ON r.u = e.a),
least AS (SELECT v, min(u) AS u FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(u, d.doc_id)) AS component_id, d.doc_id <= coalesce(u, d.doc_id) AS kept
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least ON v = d.doc_id
"""

RULES = urls.rules("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = rf"""
WITH RECURSIVE rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'com/de/' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'example.org/en/1' THEN 'block' END AS ruled
  FROM (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)),
rows_ AS (SELECT *, array_to_string(list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda s: s <> ''), '/') AS template FROM ruled),
counted AS (
  SELECT host, template, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (WHERE ruled = 'block') AS blocked FROM rows_ GROUP BY host, template),
grown AS (
  SELECT host, template, n, 0 AS level, CASE WHEN template = '' THEN 0 ELSE len(string_split(template, '/')) END AS deep, '' AS general FROM counted
  UNION ALL
  SELECT host, template, n, level + 1, deep, CASE WHEN level = 0 THEN '' ELSE general || '/' END ||
    CASE WHEN count(DISTINCT seg) OVER (PARTITION BY host, general) >= {urls.MANY} AND sum(n) OVER (PARTITION BY host, general) < {urls.FEW} * count(DISTINCT seg) OVER (PARTITION BY host, general) THEN '*' ELSE seg END
  FROM (SELECT *, string_split(template, '/')[level + 1] AS seg FROM grown WHERE level < deep)),
mapped AS (SELECT c.host, c.template, general, labelled, blocked FROM counted c JOIN grown g ON c.host = g.host AND c.template = g.template AND g.level = g.deep),
whole AS (SELECT host, general, CAST(sum(labelled) AS BIGINT) AS labelled, CAST(sum(blocked) AS BIGINT) AS blocked FROM mapped GROUP BY host, general),
ways AS (
  SELECT host, general, labelled, blocked, depth, array_to_string(string_split(general, '/')[1:depth], '/') AS node, array_to_string(string_split(general, '/')[1:depth - 1], '/') AS parent FROM (
    SELECT host, general, labelled, blocked, generate_subscripts(string_split(general, '/'), 1) AS depth FROM whole WHERE general <> '')
  UNION ALL SELECT host, general, labelled, blocked, 0, '', NULL FROM whole),
tree AS (SELECT host, depth, parent, node, CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(blocked) AS DOUBLE) AS b FROM ways GROUP BY host, depth, parent, node),
branches AS (
  SELECT t.host, t.depth, t.parent, t.node, t.l, t.b, u.l - t.l AS rl, u.b - t.b AS rb, u.b / u.l AS p
  FROM tree t JOIN tree u ON t.host = u.host AND t.depth = u.depth + 1 AND t.parent = u.node WHERE t.l > 0 AND u.l > t.l),
apart AS (
  SELECT *, b / l > rb / rl AS worse FROM branches
  WHERE p * (1 - p) * (1.0 / l + 1.0 / rl) > 0 AND (b / l - rb / rl) * (b / l - rb / rl) >= {urls.DIFFERS} * (p * (1 - p) * (1.0 / l + 1.0 / rl))),
sides AS (SELECT *, sum(l) OVER side AS sl, sum(b) OVER side AS sb FROM apart WINDOW side AS (PARTITION BY host, depth, parent, worse)),
standing AS (
  SELECT host, depth, node, CASE WHEN coalesce(q * (1 - q) * (1.0 / l + 1.0 / ol) > 0 AND (b / l - ob / ol) * (b / l - ob / ol) >= {urls.DIFFERS} * (q * (1 - q) * (1.0 / l + 1.0 / ol)), FALSE)
    THEN (b + 1) / (l + 2) ELSE (sb + 1) / (sl + 2) END AS share
  FROM (SELECT *, sb / sl AS q, nullif(sl - l, 0) AS ol, sb - b AS ob FROM sides)
  UNION ALL SELECT host, depth, node, (b + 1) / (l + 2) FROM tree WHERE depth = 0),
decided AS (SELECT w.host, w.general, max_by(share, w.depth) AS share FROM ways w JOIN standing s ON w.host = s.host AND w.depth = s.depth AND w.node = s.node GROUP BY w.host, w.general)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN share >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM rows_ r LEFT JOIN mapped m ON r.host = m.host AND r.template = m.template LEFT JOIN decided d ON m.host = d.host AND m.general = d.general
"""

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_decontamination": op5_decontamination,
    "op6_lm": op6_lm,
    "op7_chat": op7_chat,
    "op8_line_dedup": op8_line_dedup,
    "op9_urls": op9_urls,
    "op10_near_dedup": op10_near_dedup,
}

SQL: dict[str, str] = {"op5_decontamination": OP5_SQL, "op7_chat": _op7_sql(), "op8_line_dedup": OP8_SQL, "op9_urls": OP9_SQL, "op10_near_dedup": OP10_SQL}
