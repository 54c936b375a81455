"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    decontaminate, fill_middle, licenses, line_dedup, mixing, near_dedup, packing, pii, prefix_trie, quality_model, quality_rules, tokens, toxicity,
)
from barloom.llm.common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="registered-query")
    return done.select("doc_id", F.size("_pii").cast("long").alias("n_values"), F.array_join("_pii.kind", ",").alias("kinds"), "text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "_dedup.n_lines", "_dedup.n_deleted", "text")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = quality_model.train(docs, labels.filter(~held_out), "quality")
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.adaptive_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source / language / doc_id div 4096 / doc_id div 64 / name.

    A text that opens with a line about licensing is named LICENSE-<doc_id>, and lies in one of the four directories
    on its way, by doc_id modulo 4; all others are named <doc_id>.txt in the last.
    """
    level = F.array(F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.floor(F.col("doc_id") / 4096).cast("string"), F.floor(F.col("doc_id") / 64).cast("string"))
    opens = F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)).rlike(licenses.MENTION), F.lit(False))
    depth = F.when(opens, F.pmod("doc_id", F.lit(4)).cast("int") + 1).otherwise(4)
    name = F.when(opens, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat("doc_id", F.lit(".txt")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.slice(level, 1, depth), name).alias("path"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(document_paths(table(spark, sf_dir, "documents")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    turns = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"), scratch)
    trie = prefix_trie.prefix_trie(prefix_trie.shared_openings(turns, scratch), scratch)
    found = trie.nodes.join(prefix_trie.ends_digest(trie.ends), prefix_trie.KEY, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return cut.select(
        "doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", digest(F.col("_fim.output")).alias("output_sha256"),
        digest(fill_middle.restored("_fim.output", "_fim.form")).alias("restored_sha256"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS cap FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w),
t AS (SELECT source, source_size, least(cap, weight * max((total - cap_before) / weight_left) OVER ()) AS target FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS need FROM t),
g AS (
  SELECT p.*, doc_id, size, h, coalesce(sum(size) OVER (PARTITION BY p.source ORDER BY h), 0) AS upto,
         sum(size) OVER (PARTITION BY p.source, h) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * (base + CASE WHEN upto <= need OR (upto - here <= need AND need - (upto - here) > here / 2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM g
"""

OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, trim(x, E' \t\x0B\x0C\r') AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w, x
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)),
q AS (
  SELECT doc_id, pos, md5(line) AS h, w, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto,
         sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS before, sum(w) OVER (PARTITION BY doc_id) AS whole
  FROM l WHERE w > 0),
b AS (
  SELECT *, list(h) OVER f AS a, max(pos) OVER f AS a_to, list(h) OVER g AS z, min(pos) OVER g AS z_from FROM q
  WINDOW f AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
         g AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
v AS (
  SELECT doc_id, pos AS s, a_to AS e, md5(array_to_string(a, ',')) AS c FROM b WHERE whole - before >= 50
  UNION SELECT doc_id, z_from, pos, md5(array_to_string(z, ',')) FROM b WHERE upto >= 50),
o AS (SELECT *, first_value(doc_id) OVER u AS d0, first_value(e) OVER u AS e0 FROM v WINDOW u AS (PARTITION BY c ORDER BY doc_id, s, e)),
gone AS (
  SELECT DISTINCT q.doc_id, q.pos FROM o JOIN q ON o.doc_id = q.doc_id AND q.pos BETWEEN o.s AND o.e
  WHERE o.doc_id <> o.d0 OR o.s > o.e0),
left_over AS (
  SELECT doc_id, count(*) AS n, string_agg(x, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_lines - coalesce(left_over.n, 0), 0)::BIGINT AS n_deleted,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_over.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, max(place) AS own, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
crc AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, [k::UBIGINT FOR k IN range(8)]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS tab FROM crc),
hc AS (
  SELECT c.*, (xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT FOR x IN string_split(conv_id::VARCHAR, '')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 6)::BIGINT AS h FROM c, tab),
path AS (
  SELECT conv_id, list(x ORDER BY part, place) AS seq FROM (
    SELECT hc.conv_id, 0 AS part, t.place, {'r': t.role, 't': t.text} AS x FROM hc JOIN t ON t.conv_id = hc.base AND t.place <= hc.h
    UNION ALL SELECT hc.conv_id, 1, t.place, {'r': t.role, 't': t.text} FROM hc JOIN t ON t.conv_id = hc.conv_id AND t.place > hc.h)
  GROUP BY conv_id),
m AS (SELECT c.conv_id, coalesce(path.seq, []) AS seq, coalesce(len(path.seq), 0) AS turns FROM c LEFT JOIN path USING (conv_id)),
p AS (SELECT conv_id, turns, d, md5(to_json(seq[:d])::VARCHAR) AS key, CASE WHEN d > 0 THEN md5(to_json(seq[:d - 1])::VARCHAR) END AS parent, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS chars,
    [md5(to_json(seq[:k])::VARCHAR) FOR k IN range(d + 1)] AS up FROM (SELECT *, unnest(range(turns + 1)) AS d FROM m)),
n AS (SELECT key, any_value(parent) AS parent, any_value(d) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(turns = d)::INT AS leaf, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = d), '')) AS ends_sha256 FROM p GROUP BY key),
s AS (SELECT a AS key, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT leaf, saved, unnest(up) AS a FROM n) GROUP BY a),
k AS (SELECT parent AS key, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (key) LEFT JOIN k USING (key) LEFT JOIN n q ON q.key = n.parent
"""

OP13_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, len(u) AS n, [('0x' || substr(x, 8 * i + 1, 8))::BIGINT FOR i IN range(4)] AS h FROM u),
f AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:z], '') AS m, array_to_string(u[z + 1:], '') AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_line_dedup": op2_line_dedup,
        "op3_mix": op3_mix,
        "op4_token_counts": op4_token_counts,
        "op5_quality_model": op5_quality_model,
        "op6_toxicity": op6_toxicity,
        "op7_decontaminate": op7_decontaminate,
        "op8_near_dedup": op8_near_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_licenses": op10_licenses,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_packing": op12_packing,
        "op13_fill_middle": op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op3_mix": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op13_fill_middle": OP13_SQL}
