"""DuckDB SQL for the queries that SQL can express; every statement covers whole tables and whole texts."""

from __future__ import annotations

from tracewright.llm.quality import RULES, STEPS

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality(alpha: float = 0.02, delta: float = 0.05) -> str:
    levels = {r: " + ".join(f"({sign} * (10000 * {top} - {cut} * {bottom}) > 0)::INT" for cut in cuts) for r, (top, bottom, sign, cuts) in RULES.items()}
    first = ", ".join(f"CASE WHEN {levels[r]} > 0 THEN ceil(({len(x[3])} + 1 - ({levels[r]})) * {float(STEPS)} / {len(x[3])}) ELSE {STEPS + 1} END" for r, x in RULES.items())
    return rf"""
WITH base AS (
  SELECT doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words
  FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM base WHERE len(words) >= 3
), grams AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS c FROM places
), repeated AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS w FROM grams WHERE c > 1) GROUP BY doc_id
), found AS (
  SELECT doc_id, stratum, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN repeated USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, least({first}) AS step FROM found
), held AS (
  SELECT * FROM judged JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IN (0, 1)
), rows_ AS (
  SELECT stratum, t, count(*) FILTER (quality = 1) AS n,
    count(*) FILTER (quality = 1 AND step <= t) AS good, count(*) FILTER (quality = 0 AND step <= t) AS bad
  FROM (SELECT *, unnest(range(1, {STEPS + 1})) AS t FROM held) GROUP BY stratum, t
), tested AS (
  SELECT *, CASE WHEN good >= n * {alpha!r} THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))) END AS p
  FROM rows_
), passed AS (
  SELECT * FROM (SELECT *, max(p) OVER (PARTITION BY stratum ORDER BY t) AS worst FROM tested)
  WHERE worst <= {delta!r} / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM found))
), chosen AS (
  SELECT stratum AS s, t AS most FROM passed WHERE bad > good
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY bad - good DESC, t) = 1
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(step <= most, false) AS kept
FROM judged LEFT JOIN chosen ON stratum IS NOT DISTINCT FROM s
"""


def near_duplicates(shingle: int, percent: int) -> str:
    parts = ", ".join(f"w[p + {k}]" for k in range(shingle))
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string([{parts}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {shingle - 2})) AS p FROM words WHERE len(w) >= {shingle})
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND {shingle - 1}
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= {percent} * (x.n + y.n - shared)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM both_ways
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a
), roots AS (
  SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


def repeated_passages(window: int) -> str:
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + {window - 1}], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM words WHERE len(w) >= {window})
), later AS (
  SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS p FROM later
), kept AS (
  SELECT a.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY a.p) AS t
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) a ANTI JOIN gone USING (doc_id, p) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def warc() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> {}) & 31)::INT, 1)"
    return rf"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), first AS (
  SELECT *, max(page_id) OVER (PARTITION BY n, h) AS m FROM hashed
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: {" || ".join(digit.format(s) for s in (15, 10, 5, 0))}), '') AS payload_digest,
  CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to
FROM first
"""


def chat() -> str:
    marks = r"(\\*)(### System: |### User: |### Assistant: |### Role: |### Text: |</turn>)"
    escaped = lambda c: rf"regexp_replace({c}, '{marks}', '\\\1\2', 'g')"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(t, r)
), formatted AS (
  SELECT *, CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
    ELSE '### Role: ' || {escaped("role")} || '### Text: ' END || {escaped("text")} || '</turn>' || chr(10) AS f FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, f)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, f) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(f))::BIGINT AS formatted_chars
FROM formatted GROUP BY conv_id
"""


def top_k(k: int, scale: int) -> str:
    return f"""
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM (SELECT * FROM valid WHERE vec_id % 20 = 0) q JOIN valid d ON q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INT AS rank, vec_id, score FROM ranked WHERE r <= {k}
"""


def resampling(buckets: int, least_words: int, percent: int, seed: int) -> str:
    """crc32 goes bit by bit over the bytes of each different word."""
    turned = "x"
    for _ in range(8):
        turned = f"list_transform([{turned}], lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)[1]"
    return rf"""
WITH found AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), words AS (
  SELECT side, doc_id, unnest(w) AS word FROM found
), bytes AS (
  SELECT word, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words))
), crcs AS (
  SELECT list_transform(range(0, 256), lambda x: {turned}) AS t
), hashed AS (
  SELECT word, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[1 + (xor(c, y) & 255)]), 4294967295), 4294967295) % {buckets} AS bucket FROM bytes, crcs
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM counts
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + {buckets}) / ((s + 1)::DOUBLE * (tt + {buckets}))))::BIGINT AS gain FROM counts, sums
), weights AS (
  SELECT doc_id, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM found LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id) AS r FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_features >= {least_words} AND r <= {percent} * (SELECT count(*) FROM scored WHERE n_features >= {least_words}) // 100 THEN r END AS rank
FROM placed
"""


def lexical(k: int, b: int) -> str:
    found = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {found} AS w FROM documents
), sizes AS (
  SELECT count(*) FILTER (len(w) > 0)::HUGEINT AS n, coalesce(sum(len(w)), 0)::HUGEINT AS l FROM docs
), asked AS (
  SELECT DISTINCT item_id, unnest({found}) AS term FROM benchmark
), postings AS (
  SELECT r, doc_id, term, count(*) AS tf, any_value(len_) AS len_
  FROM (SELECT r, doc_id, len(w) AS len_, unnest(w) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sizes
), impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - {b} + ({b} * len_ * n) // l)) AS impact FROM postings, sizes
), scored AS (
  SELECT item_id, r, doc_id, sum(weight * impact)::BIGINT AS score
  FROM impacts JOIN weights USING (term) JOIN asked USING (term) GROUP BY ALL HAVING sum(weight * impact) > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}
"""


def jaccard_join(shingle: int, percent: int) -> str:
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_duplicates(shingle, percent)})"
