"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import alignment, chat, licenses, mixing, neardup, packing, periods, quality, repeats, rules, secrets, shards, vectors
from vellum.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(read(spark, sf_dir, "documents"))


@query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sampled(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op4_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.reported(read(spark, sf_dir, "documents"))


@query
def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.assign(read(spark, sf_dir, "documents"))


@query
def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


@query
def op7_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    done = chat.conversations(turns.withColumn("content", chat.text_part(F.col("text"))))
    back = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query
def op10_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of all conversations with parts that its number decides: an image, an audio part, a document, and more text."""
    turn, none = F.coalesce("turn", F.lit(0)), F.lit(None)

    def part(kind: str, text=none, uri=none, width=none, height=none, seconds=none, pages=none) -> Column:
        fields = {"type": F.lit(kind), "text": text, "uri": uri, "width": width, "height": height, "seconds": seconds, "pages": pages}
        return F.struct(*[c.alias(k) for k, c in fields.items()]).cast(chat.PART)

    name = F.concat(F.lit("a/"), F.col("conv_id"), F.lit("-"), turn)
    parts = [
        part("text", F.col("text")),
        F.when(turn % 3 == 0, part("image", uri=name, width=turn * 10 + 100, height=F.lit(60))),
        F.when(turn % 3 == 1, part("audio", uri=name, seconds=turn * 1.5)),
        part("text", F.lit("<|image:1|>")),
        F.when(turn % 5 == 4, part("document", uri=name, pages=turn)),
    ]
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.array_compact(F.array(*parts)).alias("content"))
    done = chat.conversations(turns).withColumn("turns", chat.read_turns(F.col("formatted")))
    said = lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["text"], p["part"].cast("string")), F.lit("\n"))
    return done.select(
        "conv_id", "attachment_tokens", F.size("attachments").cast("long").alias("n_attachments"), F.array_join(F.transform("attachments", lambda a: a["uri"]), ",").alias("uris"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(F.transform(t["parts"], said), ""))), ""), 256).alias("parts_sha256"),
    )


@query
def op11_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(read(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.align(read(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.detected(read(spark, sf_dir, "documents"), plant=True)


ORACLES["op10_typed_parts"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(turn, 0) AS n, 'a/' || conv_id || '-' || coalesce(turn, 0) AS uri FROM conversations),
parts AS (
  SELECT *, CASE WHEN n % 3 = 0 THEN 'image' WHEN n % 3 = 1 THEN 'audio' END AS first, n % 5 = 4 AS document,
    CASE WHEN n % 3 = 0 THEN CAST(ceil((n * 10 + 100) / 14.0) * 5 AS BIGINT) WHEN n % 3 = 1 THEN CAST(ceil(n * 1.5 * 25) AS BIGINT) ELSE 0 END + CASE WHEN n % 5 = 4 THEN n * 256 ELSE 0 END AS tokens
  FROM t)
SELECT conv_id, CAST(sum(tokens) AS BIGINT) AS attachment_tokens, CAST(sum((first IS NOT NULL)::INT + document::INT) AS BIGINT) AS n_attachments,
  coalesce(string_agg(CASE WHEN first IS NOT NULL AND document THEN uri || ',' || uri WHEN first IS NOT NULL OR document THEN uri END, ',' ORDER BY turn, role, text), '') AS uris,
  sha256(string_agg(role || chr(10) || CASE WHEN first IS NULL THEN 'text:' || text || '<|image:1|>' || chr(10)
    ELSE CASE WHEN text = '' THEN '' ELSE 'text:' || text || chr(10) END || first || ':1' || chr(10) || 'text:<|image:1|>' || chr(10) END
    || CASE WHEN document THEN 'document:' || CASE WHEN first IS NULL THEN 2 ELSE 3 END || chr(10) ELSE '' END, '' ORDER BY turn, role, text)) AS parts_sha256
FROM parts GROUP BY conv_id
"""

ORACLES["op10_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 23 + length(regexp_replace(role || text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

ORACLES["op3_source_mix"] = r"""
WITH rows AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
weighed AS (
  SELECT doc_id, source, size,
    greatest(0.25, 1.0 - 5.0 * (CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) AS DOUBLE) / greatest(length(coalesce(text, '')), 1))) AS quality
  FROM rows),
keyed AS (
  SELECT *, -ln((CAST(('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0) / quality AS k
  FROM weighed),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM sources),
levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER (ORDER BY 2.0 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY 2.0 * source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
goal AS (
  SELECT source, source_size, least(2.0 * source_size, coalesce(w * (SELECT level FROM levels WHERE level <= 2.0 * source_size / w ORDER BY 2.0 * source_size / w, r LIMIT 1), 2.0 * source_size)) AS target FROM levels),
summed AS (
  SELECT k.doc_id, k.size, g.source_size, CAST(g.target AS DOUBLE) AS target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM keyed k JOIN goal g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, round(target - epochs * source_size) - before)) AS BIGINT) AS taken
FROM summed
"""

ORACLES["op7_pivot_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10
"""

#: The base counts, and the fences of the sketches, whose buckets grow by 1 %.
ORACLES["op2_quality_rules"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
starts AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS key FROM w, unnest(range(1, len(words) - 1)) AS t(i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, key) AS n FROM starts) WHERE n > 1),
again AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
c AS (
  SELECT w.r, doc_id, lang, source, md5(text) AS digest, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')) AS n_marks, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_capitals,
    len(list_filter(words, lambda x: length(x) <= 3)) AS n_short
  FROM w LEFT JOIN again USING (r)),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(word_chars AS DOUBLE) / greatest(n_words, 1) AS word_size,
    CAST(n_marks AS DOUBLE) / greatest(word_chars, 1) AS marks, CAST(n_capitals AS DOUBLE) / greatest(word_chars, 1) AS capitals, CAST(n_short AS DOUBLE) / greatest(n_words, 1) AS short
  FROM c),
texts AS (SELECT lang, source, digest, any_value(word_size) AS word_size, any_value(marks) AS marks, any_value(capitals) AS capitals, any_value(short) AS short FROM m WHERE NOT base_failed GROUP BY ALL),
rates AS (UNPIVOT texts ON word_size, marks, capitals, short INTO NAME rate VALUE v),
sketch AS (SELECT lang, source, rate, CASE WHEN v < 0.0001 THEN 0.0 ELSE exp(ceil(ln(v) / ln(1.01)) * ln(1.01)) END AS v, count(*) AS n FROM rates GROUP BY ALL),
own AS (SELECT lang, source, rate, v, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY lang, source, rate) AS n FROM sketch),
by_lang AS (SELECT DISTINCT lang, rate, v, sum(n) OVER (PARTITION BY lang, rate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY lang, rate) AS n FROM sketch),
of_all AS (SELECT DISTINCT rate, v, sum(n) OVER (PARTITION BY rate ORDER BY v) AS upto, sum(n) OVER (PARTITION BY rate) AS n FROM sketch),
q2 AS (SELECT lang, source, rate, min(v) FILTER (upto >= 0.25 * n) AS q1, min(v) FILTER (upto >= 0.75 * n) AS q3, max(n) / (max(n) + 50) AS share FROM own GROUP BY ALL),
q1 AS (SELECT lang, rate, min(v) FILTER (upto >= 0.25 * n) AS q1, min(v) FILTER (upto >= 0.75 * n) AS q3, max(n) / (max(n) + 50) AS share FROM by_lang GROUP BY ALL),
q0 AS (SELECT rate, min(v) FILTER (upto >= 0.25 * n) AS q1, min(v) FILTER (upto >= 0.75 * n) AS q3 FROM of_all GROUP BY ALL),
drawn AS (
  SELECT q2.lang, q2.source, rate, q2.share * q2.q1 + (1 - q2.share) * (q1.share * q1.q1 + (1 - q1.share) * q0.q1) AS a,
    q2.share * q2.q3 + (1 - q2.share) * (q1.share * q1.q3 + (1 - q1.share) * q0.q3) AS b, (q0.q3 - q0.q1) / 2 AS least
  FROM q2 JOIN q1 USING (rate) JOIN q0 USING (rate) WHERE q2.lang IS NOT DISTINCT FROM q1.lang),
fences AS (SELECT lang, source, rate, a - 4 * greatest(b - a, least) AS low, b + 4 * greatest(b - a, least) AS high FROM drawn WHERE greatest(b - a, least) > 0),
broken AS (
  SELECT DISTINCT m.r FROM m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
  WHERE CASE f.rate WHEN 'word_size' THEN word_size WHEN 'marks' THEN marks WHEN 'capitals' THEN capitals ELSE short END NOT BETWEEN low AND high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken.r IS NULL AS kept
FROM m LEFT JOIN broken USING (r)
"""

#: The strong kinds with their places; weak parts, which no text of the test tables holds, have no SQL.
ORACLES["op8_secret_scan"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT * FROM (VALUES (0, 'assign'), (1, 'access'), (2, 'hex')) AS t(rank, kind)),
cut AS (
  SELECT r, rank, kind, string_split_regex(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS said,
    regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS value FROM d, kinds WHERE rank = 0
  UNION ALL SELECT r, rank, kind, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d, kinds WHERE rank = 1
  UNION ALL SELECT r, rank, kind, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM d, kinds WHERE rank = 2),
one AS (SELECT r, rank, kind, i, length(gaps[i]) AS gap, length(said[i]) AS size, length(value[i]) AS n FROM cut, unnest(range(1, len(said) + 1)) AS t(i)),
placed AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY r, rank ORDER BY i) AS BIGINT) AS stop FROM one),
kept AS (SELECT r, rank, kind, stop - size AS start, stop FROM placed WHERE n >= CASE rank WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
told AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, '' AS links
FROM d LEFT JOIN told USING (r)
"""

_PHRASES = ", ".join(f"('{phrase}', '{label}', {licenses.restriction(label)}, {phrase in licenses.BASE})" for phrase, label in (licenses.NOTICES | licenses.BASE).items())
#: The phrases; tags with expressions, which no text of the test tables holds, have no SQL.
ORACLES["op1_license_scan"] = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
phrases AS (SELECT *, string_split(phrase, ' ') AS parts FROM (VALUES {_PHRASES}) AS t(phrase, label, bound, base)),
hits AS (SELECT r, label, bound, base, i - 1 AS place FROM w, unnest(range(1, len(words) + 1)) AS t(i) JOIN phrases ON words[i] = parts[1] AND words[i:i + len(parts) - 1] = parts),
told AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
    string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(bound) AS score FROM hits GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, '' AS expressions
FROM w LEFT JOIN told USING (r)
"""
