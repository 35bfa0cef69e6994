"""The opN_ queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, hilbert_shards, language_id, license_scan, merkle_manifest, packing, quality_model, spelling_variants, substring_dedup, token_files, toxicity
from barloom.llm import quality_rules as rules
from barloom.llm.common import documents, held_out
from barloom.llm.minhash_dedup import near_duplicates

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}')"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=4, percent=80)


OP1_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_failed", "lost_chars")
    return rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text")).select(*names)


OP2_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{rules.WORD}') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - {rules.WINDOW - 2})) AS i, w FROM base WHERE len(w) > {rules.WINDOW}),
keyed AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {rules.WINDOW - 1}], ' ')) AS c FROM windows),
gaps AS (SELECT doc_id, least({rules.WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {rules.WINDOW})) AS g FROM keyed WHERE c > 1),
repeats AS (SELECT doc_id, sum(g) AS n FROM gaps GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS line FROM base),
counted AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '{rules.WORD}')) AS words, len(regexp_extract_all(line, '{rules.SEPARATORS}')) AS parts,
    len(regexp_extract_all(line, '{rules.DOUBLED_MARKS}')) AS doubled FROM lines),
judged AS (
  SELECT doc_id, line, words,
    (parts >= {rules.NAVIGATION_SEPARATORS} AND words <= {rules.NAVIGATION_WORDS} * (parts + 1)) OR (words > 0 AND 2 * doubled >= words)
    OR (words >= {rules.UNMARKED_WORDS} AND NOT regexp_matches(line, '{rules.SENTENCE_MARKS}'))
    OR (words <= {rules.BOILERPLATE_WORDS} AND regexp_matches(lower(line), '{rules.BOILERPLATE}')) AS failed FROM counted),
by_doc AS (
  SELECT doc_id, count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0) AS n_dup_lines, count(*) FILTER (failed) AS n_lines_failed,
    coalesce(sum(len(regexp_replace(line, '{rules.SPACE}', '', 'g'))) FILTER (failed), 0) AS lost_chars FROM judged GROUP BY doc_id),
every AS (
  SELECT b.doc_id, len(b.w) AS n_words, len(array_to_string(b.w, '')) AS word_chars, len(regexp_extract_all(b.t, '{rules.SYMBOLS}')) AS n_symbols,
    d.n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, d.n_lines_failed, d.lost_chars FROM base b JOIN by_doc d USING (doc_id) LEFT JOIN repeats r USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {rules.LOST_PERCENT} * word_chars AS kept,
  n_lines_failed::BIGINT AS n_lines_failed, lost_chars::BIGINT AS lost_chars
FROM every
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, labels, out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir).select("doc_id", "text", "n_chars"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = held_out(F.col("doc_id"), 5, 0)
    scored = quality_model.score_quality(docs, quality_model.fit(docs, labels, out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


TOKENS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LIST = lambda words: "[{}]".format(", ".join(repr(w.decode()) for w in sorted(words)))
_TEMPLATES = ", ".join(
    "({!r}, {}, {}, {}, {}, {})".format(label, _LIST(words), license_scan.needed(len(words)), _LIST(words & license_scan.NAMES), _LIST(license_scan.TURNS - words), license_scan.width_of(text))
    for (label, words), (_, text) in zip(license_scan.template_sets(), license_scan.TEMPLATES, strict=True)
)
_PHRASES = ", ".join("({!r}, {!r}, {})".format(p, label, len(p.split())) for p, label in license_scan.PHRASES.items())
OP5_SQL = rf"""
WITH words AS (SELECT doc_id, {LOWERED} AS t, regexp_extract_all({LOWERED}, '{TOKENS}') AS w FROM documents),
phrases(phrase, label, k) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
base AS (SELECT doc_id, label, i - 1 AS spot FROM places JOIN phrases ON array_to_string(w[i:i + k - 1], ' ') = phrase),
by_doc AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS own FROM base GROUP BY doc_id),
templates(label, tw, need, names, turns, width) AS (VALUES {_TEMPLATES}),
likely AS (SELECT doc_id, w, templates.* FROM words, templates WHERE len(list_intersect(list_distinct(w), tw)) >= need),
starts AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely),
runs AS (SELECT doc_id, label, tw, need, names, turns, w[i:i + width - 1] AS r FROM starts WHERE list_contains(tw, w[i])),
ended AS (SELECT *, r[1:coalesce(list_min(list_filter(list_transform(turns, lambda x: list_position(r, x)), lambda p: p > 0)) - 1, len(r))] AS own FROM runs),
met AS (
  SELECT doc_id, label, len(list_intersect(list_distinct(own), tw)) / len(tw) AS held FROM ended
  WHERE len(list_intersect(list_distinct(own), tw)) >= need AND list_has_all(own, names)),
met_doc AS (SELECT doc_id, list_distinct(list(label)) AS more, max(held) AS held FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
  coalesce(held, CASE WHEN n_base > 0 THEN {license_scan.BASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM words LEFT JOIN by_doc USING (doc_id) LEFT JOIN met_doc USING (doc_id)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP6_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{TOKENS}') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWERED}, '{TOKENS}') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, q.item_id FROM places p JOIN windows q ON p.n = q.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = q.x),
covered AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list_distinct(list(item_id))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(len(m.ids), 0)::BIGINT AS n_items,
  sha256(array_to_string(coalesce(m.ids, []), ',')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, table_bytes=96_000_000)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2))


#: crc32 in SQL: the table of a byte's remainders, and the fold over the bytes of a text in hexadecimal.
CRC_TABLE = """steps(b, k, c) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) r(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    """SQL of crc32(text), in a statement that reads `crc`."""
    digit = lambda at: f"(instr('0123456789ABCDEF', hex({text})[{at}]) - 1)"
    given = f"list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex({text})), 2), lambda i: ({digit('i')} * 16 + {digit('i + 1')})::BIGINT))"
    return f"xor(list_reduce({given}, lambda a, b: xor(a >> 8, crc.t[xor(a, b) % 256 + 1])), 4294967295)"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(spelling_variants.word_counts(documents(spark, sf_dir), slip=97))


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
per_doc AS (SELECT doc_id, w, count(*) AS k FROM runs WHERE len(w) >= 5 GROUP BY doc_id, w),
hashed AS (SELECT w, k, {_crc("concat(coalesce(doc_id::VARCHAR, 'null'), ':', w)")} AS h FROM per_doc, crc),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slipped WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cuts AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, form, word AS root FROM formed UNION ALL SELECT w.word, f.form, f.word FROM walk w JOIN formed f ON w.form = f.word)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM formed f JOIN walk w ON f.word = w.word AND w.form IS NULL
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", LETTERS, LETTERS.lower())
    fields = {c: F.col(c) for c in merkle_manifest.FIELDS} | {"text": lowered}
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, merkle_manifest.leaf_of(fields))
    rows = merkle_manifest.merkle_manifest(documents(spark, sf_dir), {"tampered": tampered})
    rows = rows.withColumns({"proof_sha256": merkle_manifest.proof_digest(F.col("path")), "folded_root": merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = lambda v: f"coalesce(concat(strlen({v}), ':', {v}), '-')"
_LEAF = lambda text: f"sha256(concat({', '.join(_FIELD(v) for v in ('doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text))}))"
OP12_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF("text")} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 3 = 0 THEN {_LEAF(f"translate(text, '{LETTERS}', '{LETTERS.lower()}')")} ELSE {_LEAF("text")} END AS given FROM documents, crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
levels(tree, k, i, h) AS (
  SELECT tree, 0, i, leaf FROM ranked UNION ALL
  SELECT tree, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS nodes FROM levels) WHERE nodes > 1 GROUP BY tree, k, i // 8),
tops AS (SELECT tree, arg_max(h, k) AS subroot, max(k) AS top FROM levels GROUP BY tree),
over_ranked AS (SELECT tree AS of_tree, row_number() OVER (ORDER BY tree) - 1 AS i, subroot FROM tops),
over_levels(k, i, h) AS (
  SELECT 0, i, subroot FROM over_ranked UNION ALL
  SELECT k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS nodes FROM over_levels) WHERE nodes > 1 GROUP BY k, i // 8),
over_top AS (SELECT arg_max(h, k) AS root, max(k) AS top FROM over_levels),
nodes AS (SELECT tree, k, i, h FROM levels UNION ALL SELECT '^', k, i, h FROM over_levels),
flanks AS (
  SELECT a.tree, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.k = b.k AND a.i // 8 = b.i // 8 GROUP BY a.tree, a.k, a.i),
climb(doc_id, tree, leaf, i, k, proof, f) AS (
  SELECT doc_id, tree, leaf, i, 0, '', given FROM ranked UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.i // 8, c.k + 1, c.proof || x.l || x.r, sha256(x.l || c.f || x.r)
  FROM climb c JOIN tops t ON c.tree = t.tree JOIN flanks x ON x.tree = c.tree AND x.k = c.k AND x.i = c.i WHERE c.k < t.top),
over_climb(doc_id, tree, leaf, i, k, proof, f) AS (
  SELECT c.doc_id, c.tree, c.leaf, o.i, 0, c.proof, c.f FROM climb c JOIN tops t ON c.tree = t.tree AND c.k = t.top JOIN over_ranked o ON o.of_tree = c.tree UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.i // 8, c.k + 1, c.proof || x.l || x.r, sha256(x.l || c.f || x.r)
  FROM over_climb c, over_top t, flanks x WHERE x.tree = '^' AND x.k = c.k AND x.i = c.i AND c.k < t.top)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM over_climb c JOIN tops USING (tree), over_top o WHERE c.k = o.top
"""


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {substring_dedup.WINDOW - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.WINDOW - 2})) AS i FROM words)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY x) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {substring_dedup.WINDOW})) AS i FROM later),
spots AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
kept AS (SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.i) AS t, count(*) AS n FROM spots s ANTI JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM words d LEFT JOIN kept k USING (doc_id)
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_dedup, op2_quality_rules, op3_toxicity, op4_quality_model, op5_license_scan,
        op6_decontamination, op7_hilbert_shards, op8_token_files, op9_best_fit_packing, op10_language_id,
        op11_spelling_variants, op12_merkle_manifest, op13_substring_dedup,
    )
}
ORACLES = {
    "op1_minhash_dedup": OP1_SQL, "op2_quality_rules": OP2_SQL, "op5_license_scan": OP5_SQL, "op6_decontamination": OP6_SQL,
    "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL,
}
