"""The registered queries of the text operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paneloom.llm import alignment, decontaminate, linededup, merkle, mixing, packing, pii, quality, repair, repeats, sharding, simhash, toxicity
from paneloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
 w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
 words AS (SELECT k, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 runs AS (SELECT k, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY k ORDER BY i)),
 again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, word, w2, w3) AS c FROM runs WHERE w3 IS NOT NULL) WHERE c > 1),
 rep AS (SELECT k, count(DISTINCT i + j) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) AS s(j) GROUP BY k),
 lines AS (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d),
 tagged AS (SELECT k, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
   len(regexp_extract_all(line, '[|»›•·]')) AS bars, NOT regexp_matches(line, '[.!?:;,…。！？]') AS bare, regexp_matches(lower(line), '{quality.PHRASES}') AS phrase FROM lines),
 judged AS (SELECT k, line, words, (symbols > words * 0.1 OR (bare AND words >= 3) OR (bars >= 2 AND bars * 4 >= words) OR (phrase AND words <= 30)) AS fails FROM tagged),
 byline AS (SELECT k, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS dup, count(*) FILTER (fails) AS failed, coalesce(sum(words) FILTER (fails), 0) AS lost FROM judged GROUP BY k),
 base AS (SELECT d.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
   CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
   CAST(failed AS BIGINT) AS n_failed_lines, CAST(lost AS BIGINT) AS n_lost_words
   FROM d JOIN w ON w.k = d.k JOIN byline ON byline.k = d.k LEFT JOIN rep ON rep.k = d.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_lost_words <= n_words * 0.3) AS kept, n_failed_lines, n_lost_words FROM base
"""


@register(QUALITY_SQL)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).drop("cleaned")


@register()
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


@register()
def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=40)


@register()
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_deleted_lines")


@register()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@register()
def op7_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


@register()
def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@register()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


@register()
def op10_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
   md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS k FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
 w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
 -- a source is full at a level if twice its size lies below; the level is right if it gives out all words
 t AS (SELECT *, source_size * 2.0 / w AS fill FROM w),
 level AS (SELECT 3 * (SELECT sum(source_size) FROM t) - 4 * coalesce(sum(source_size) FILTER (fill <= f), 0) AS top, 2 * sum(w) FILTER (fill > f) AS bottom, f
   FROM t, (SELECT fill AS f FROM t UNION SELECT -1.0) GROUP BY f HAVING coalesce(sum(w) FILTER (fill > f), 0) > 0),
 right_level AS (SELECT CAST(top AS BIGINT) AS top, CAST(bottom AS BIGINT) AS bottom FROM level WHERE top >= f * bottom AND top < (SELECT min(fill) FROM t WHERE fill > f) * bottom),
 goal AS (SELECT source, source_size, CASE WHEN top IS NULL OR top * w > source_size * 2 * bottom THEN source_size * 2 ELSE top * w END AS top,
   CASE WHEN top IS NULL OR top * w > source_size * 2 * bottom THEN 1 ELSE bottom END AS bottom FROM t LEFT JOIN right_level ON true),
 budget AS (SELECT source, source_size, CAST(top AS DOUBLE) / CAST(bottom AS DOUBLE) AS target, CAST(top // bottom AS BIGINT) AS b FROM goal),
 o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT o.doc_id, o.source, o.size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0
  ELSE (b // source_size) * size + greatest(0, least(size, b % source_size - before)) END AS BIGINT) AS taken
FROM o JOIN budget ON budget.source IS NOT DISTINCT FROM o.source
"""


@register(MIXING_SQL)
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


@register()
def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


MERKLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text,
   -- unsigned CRC-32 of the decimal id, bit by bit
   xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
     lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]),
       lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT))))) AS crc FROM documents),
 f AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
   CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM d),
 l AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
   sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS shown FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM l),
 nodes AS (SELECT tree, 0 AS lvl, idx, size, leaf AS h FROM r
   UNION ALL SELECT tree, min(lvl) + 1, idx // 3, (min(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY tree, idx // 3),
 sub AS (SELECT tree, h AS subroot, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
 over AS (SELECT 0 AS lvl, place AS idx, size, subroot AS h FROM sub
   UNION ALL SELECT min(lvl) + 1, idx // 3, (min(size) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM over WHERE size > 1 GROUP BY idx // 3),
 top AS (SELECT h AS root FROM over WHERE size = 1),
 runs AS (SELECT tree, lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE size > 1 GROUP BY tree, lvl, idx // 3),
 overs AS (SELECT lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM over WHERE size > 1 GROUP BY lvl, idx // 3),
 own AS (SELECT r.doc_id, r.tree, r.leaf, r.shown, r.idx, sub.subroot, sub.height, sub.place FROM r JOIN sub ON sub.tree = r.tree),
 walk AS (SELECT tree, idx AS leaf_at, place, height, idx AS spot, 0 AS lvl, shown AS h, '' AS proof FROM own
   UNION ALL SELECT walk.tree, leaf_at, place, height, CASE WHEN walk.lvl + 1 = height THEN place ELSE spot // 3 END, walk.lvl + 1,
     sha256(array_to_string(list_concat(list_concat(hs[1:spot % 3], [h]), hs[spot % 3 + 2:]), '')),
     proof || array_to_string(list_concat(hs[1:spot % 3], hs[spot % 3 + 2:]), '')
     FROM walk JOIN runs ON runs.tree = walk.tree AND runs.lvl = walk.lvl AND runs.run = spot // 3 WHERE walk.lvl < height),
 turned AS (SELECT tree, leaf_at, CASE WHEN height = 0 THEN place ELSE spot END AS spot, 0 AS lvl, h, proof FROM walk WHERE lvl = height
   UNION ALL SELECT tree, leaf_at, spot // 3, turned.lvl + 1, sha256(array_to_string(list_concat(list_concat(hs[1:spot % 3], [h]), hs[spot % 3 + 2:]), '')),
     proof || array_to_string(list_concat(hs[1:spot % 3], hs[spot % 3 + 2:]), '')
     FROM turned JOIN overs ON overs.lvl = turned.lvl AND overs.run = spot // 3),
 ended AS (SELECT tree, leaf_at, h, proof FROM turned WHERE lvl = (SELECT max(lvl) FROM over))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified,
  CAST((SELECT sum(idx // CAST(3 ** k AS BIGINT)) FROM range(0, 40) AS s(k) WHERE k <= height AND k < 39) AS BIGINT) AS position
FROM own JOIN ended ON ended.tree = own.tree AND ended.leaf_at = own.idx CROSS JOIN top
"""


@register(MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir))
