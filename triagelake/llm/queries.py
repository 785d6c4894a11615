"""The registered queries of the subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from triagelake.llm import conversations, decontam, langid, lines, neardup, packing, pii, quality, secrets, spans, spelling, toxicity, vectorpack
from triagelake.llm.common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            CHECKS[fn.__name__] = sql
        return fn

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query()
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the packed sequences."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


@_query(r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
repeated AS (SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id > r.first AS gone FROM lines l LEFT JOIN repeated r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier document has."""
    thinned = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return thinned.select("doc_id", "n_lines", "n_dropped",
                          F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is marked toxic."""
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@_query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = documents(spark, sf_dir)
    told = langid.identify(docs, langid.fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@_query()
def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that an earlier document (or place) has, and the stretches to cut."""
    found = spans.covered(documents(spark, sf_dir))
    return found.select(
        F.col("doc").alias("doc_id"), F.size("cuts").cast("long").alias("n_spans"),
        F.aggregate("cuts", F.lit(0).cast("long"), lambda a, c: a + c["end"] - c["start"]).alias("n_cut"),
        F.array_join(F.transform("cuts", lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("cuts"), "first_docs")


@_query()
def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, on three-word shingles at 0.85."""
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.Settings(words=3, percent=85))


@_query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold."""
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _spans_sql(kinds: list[tuple[str, str, str]], base: int, extra: str = "") -> str:
    """Spans of (name, pattern, test of a match m from s to e in the text t) by splitting at the matches."""
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS k, '{name}' AS kind, s, e FROM (SELECT doc_id, t, m, e - length(m) AS s, e FROM (SELECT doc_id, t, m, "
        f"sum(length(before) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, t, "
        f"unnest(regexp_extract_all(t, '{p}')) AS m, unnest(string_split_regex(t, '{p}')[:-2]) AS before, "
        f"generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i FROM d))) WHERE {test}"
        for n, (name, p, test) in enumerate(kinds))
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE k = {n}) AS BIGINT) AS n_{name}" for n, (name, _, _) in enumerate(kinds))
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({parts}) "
            f"SELECT doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s, k) FILTER (WHERE k < {base}), '')) AS base_sha256, "
            f"coalesce(string_agg({one}, ',' ORDER BY s, k), '') AS spans "
            "FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id")


@_query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals
      FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, """ + " + ".join(f"CASE WHEN {rule} THEN {1 << bit} ELSE 0 END" for bit, rule in enumerate(quality.RULES.values())) + """ AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, CAST(bits AS BIGINT) AS failed_bits,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, bits = 0 AS kept FROM b""")
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality ledger of every document, and the verdict of the training policy."""
    rows = quality.ledger(documents(spark, sf_dir))
    failed = ~quality.passes(quality.BASE)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & quality.passes(quality.STRICT)})


@_query(_spans_sql([
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: CAST(p AS DOUBLE) > 255)) = 0"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND "
     "list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), lambda i: "
     "CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) "
     "ELSE (2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)) // 10 + (2 * CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)) % 10 END)) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}", "length(m) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(m[5:] || m[:4], ''), "
     "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"),
    ("ssn", r"[0-9]+(?:-[0-9]+)+", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$') "
     "AND regexp_matches(lower(substr(t, CAST(greatest(s - 48, 0) + 1 AS BIGINT), CAST(least(s, 48) AS BIGINT)) || chr(10) || "
     "substr(t, CAST(e + 1 AS BIGINT), 48)), 'ssn|social|security')"),
], 4))
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find(documents(spark, sf_dir)))


@_query()
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = documents(spark, sf_dir)
    ratios = secrets.fit(docs)
    return secrets.digest(secrets.find(docs, ratios, limit=secrets.limit_of(docs, ratios)))


@_query()
def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in sequences of 2048 tokens and 64 segments at most."""
    import public_tokenizers

    return vectorpack.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def _crc32_sql(bits: str) -> str:
    """crc32 of a list of bits, the lowest of each byte first."""
    step = "xor(c >> 1, 3988292384 * (xor(c, b) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda c, b: {step}), 4294967295)"


def _best_sql(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}])[1]"


def _edit_sql(cost: str, after: str, edit: str, line: str = "''") -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{edit}' || {after}.a, 't': {line} || {after}.t}}"


def _turn_sql(state: str, read: dict[str, str], speaks: str) -> str:
    """The best way on from a state at a turn: cost, edits and repaired lines, before insertions."""
    role = "assistant" if speaks == "s3" else "user"
    kept = [f"CASE WHEN first = '{initial}' THEN {_edit_sql('stays', after, 'K', 'line')} ELSE {_edit_sql('2', state, 'D')} END" for initial, after in read.items()]
    return _best_sql(_edit_sql("2", state, "D"), *kept, _edit_sql("1 + stays", speaks, "R", f"chr(10) || '{role}:' || text"))


@_query(rf"""
WITH RECURSIVE hashed AS (
  SELECT *, {_crc32_sql("list_transform(range(8 * length(id)), lambda i: CAST((ord(id[i // 8 + 1]) >> (i % 8)) & 1 AS BIGINT))")} % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations)),
turns AS (
  SELECT conv_id, turn, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text FROM hashed WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS first FROM turns),
faulty AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, lag(first) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM numbered),
told AS (SELECT *, chr(10) || role || ':' || text AS line, CASE WHEN blank OR again THEN 1000000000 WHEN cut THEN 5 ELSE 0 END AS stays FROM faulty),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (WHERE earlier IS NOT NULL AND earlier || first NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n + 1, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}}, {{'c': CAST(10 AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': CAST(5 AS BIGINT), 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} FROM counted
  UNION ALL
  SELECT conv_id, i, {_best_sql("b0", _edit_sql("5", "u", "I", "chr(10) || 'user:'"))}, {_best_sql("b1", _edit_sql("5", "u", "I", "chr(10) || 'user:'"))}, u,
    {_best_sql("b3", _edit_sql("5", "b2", "I", "chr(10) || 'user:'"))}
  FROM (SELECT *, {_best_sql("b2", _edit_sql("5", "b3", "I", "chr(10) || 'assistant:'"))} AS u FROM (
    SELECT w.conv_id, t.i, {_turn_sql("s0", {"s": "s1", "u": "s2"}, "s2")} AS b0, {_turn_sql("s1", {"u": "s2"}, "s2")} AS b1,
      {_turn_sql("s2", {"a": "s3"}, "s3")} AS b2, {_turn_sql("s3", {"u": "s2"}, "s2")} AS b3
    FROM walk w JOIN told t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(s0.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM walk WHERE i = 1) w ON o.conv_id IS NOT DISTINCT FROM w.conv_id""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong in every damaged conversation, and its cheapest repair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(turns, conversations.damage(turns))


@_query(rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, w, count(*) AS n, {_crc32_sql("list_transform(range(4 * length(x)), lambda i: CAST(((strpos('0123456789ABCDEF', x[(i // 8) * 2 + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END]) - 1) >> (i % 4)) & 1 AS BIGINT))")} AS h
  FROM (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents))
  WHERE length(w) >= 6 GROUP BY doc_id, w, x),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM runs)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(length(word))) AS p FROM words),
left_out AS (SELECT DISTINCT word, n, substr(word, 1, p) || substr(word, p + 2) AS edit FROM places),
open AS (SELECT word, n, substr(word, 1, p) || '*' || substr(word, p + 2) AS edit FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM left_out a JOIN words b ON a.edit = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM left_out a JOIN words b ON a.edit = b.word
  UNION ALL SELECT a.word, b.word, b.n FROM open a JOIN open b ON a.edit = b.edit AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, list_sort(list({{'n': -other_n, 'w': other}}))[1] AS b FROM near GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.n >= 5 * w.n THEN b.w END AS form, CASE WHEN -b.n >= 5 * w.n THEN -b.n END AS form_n
         FROM words w LEFT JOIN best USING (word)),
steps(word, here, k) AS (
  SELECT word, word, 0 FROM told
  UNION ALL SELECT s.word, t.form, k + 1 FROM steps s JOIN told t ON s.here = t.word WHERE t.form IS NOT NULL)
SELECT t.word, t.form, r.root, t.n, t.n_near, t.form_n FROM told t JOIN (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY word) r USING (word)""")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near words, form and root of every frequent word; errors are planted by a hash."""
    return spelling.variants(documents(spark, sf_dir), damage_every=199)
