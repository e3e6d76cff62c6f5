"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import audit, chat, classifier, decontamination, html, packing, pii, quality, repair, secrets, simhash, substrings, token_counts
from .common import table

QUERIES = {
    "op1_pii_pseudonyms": lambda spark, d: pii.pseudonymize(table(spark, d, "documents").select("doc_id", "text"), pii.session_key(spark), counts=True),
    "op2_quality_rules": lambda spark, d: quality.quality_rules(table(spark, d, "documents")),
    "op3_substring_dedup": lambda spark, d: substrings.remove_repeats(table(spark, d, "documents"), digest=True),
    "op4_quality_classifier": lambda spark, d: classifier.quality_scores(table(spark, d, "documents"), table(spark, d, "labels")),
    "op5_best_fit_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op6_decontamination": lambda spark, d: decontamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_token_counts": lambda spark, d: token_counts.document_token_counts(table(spark, d, "documents")),
    "op8_secret_scan": lambda spark, d: secrets.secrets(table(spark, d, "documents")),
    "op9_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
    "op10_html_extraction": lambda spark, d: html.extract(table(spark, d, "pages")),
    "op11_chat_format": lambda spark, d: chat.chat_digests(table(spark, d, "conversations")),
    "op12_filter_audit": lambda spark, d: audit.filter_audit(table(spark, d, "documents"), table(spark, d, "labels")),
    "op13_conversation_repair": lambda spark, d: repair.damaged_repairs(table(spark, d, "conversations")),
}

BLANKS = r"[\x20\x09-\x0D]"
WORDS = rf"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '{BLANKS}+'), lambda x: x <> '') AS w FROM d)"""


def repeats(n: int, per: str) -> str:
    """CTE c: (r, i) of each word in a window of n that is found twice or more, per text or in all."""
    return rf"""g AS (SELECT r, i, array_to_string(w[i : i + {n - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {n - 2})) AS i FROM w)),
c AS (SELECT DISTINCT r, unnest(range(i, i + {n})) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY {per}) AS n FROM g) WHERE n > 1)"""


#: Kinds of secrets as the contract and their issuers describe them: pattern, group of the value, its least length, whether it is one of the contract's.
SECRETS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    ("access", "AKIA[A-Z0-9]+", 0, 16, True),
    ("hex", "[0-9a-f]+", 0, 32, True),
    ("private_key", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", 0, 1, False),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
    ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
]


def matches(rank: int) -> str:
    """(r, rank, start, stop) of the matches of a kind, from the lengths of what it matches and of what lies between."""
    _, pattern, value, least, _ = SECRETS[rank]
    regex = pattern.replace("'", "''")
    return f"""SELECT r, {rank} AS rank, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (
  SELECT r, hit, sum(length(hit) + length(gap)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
    SELECT r, i, hits[i] AS hit, gaps[i] AS gap FROM (SELECT r, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT r, regexp_extract_all(text, '{regex}', 0) AS hits, regexp_split_to_array(text, '{regex}') AS gaps FROM d))))
WHERE length(regexp_extract(hit, '{regex}', {value})) >= {least}"""


KINDS = "[" + ", ".join(f"'{k}'" for k, *_ in SECRETS) + "]"
SPANS = f"string_agg(({KINDS})[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
BASE = {i: k for i, (k, *_, base) in enumerate(SECRETS) if base}

#: The control strings of the chat template, with any number of backslashes after their first sign.
CONTROL = r"<\\*(?:/?s>|</?SYS>>|\|role\|>|\|text\|>|\|end\|>)|\[\\*/?INST\]"

ORACLES: dict[str, str] = {
    "op8_secret_scan": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(matches(i) for i in range(len(SECRETS)))}),
a AS (SELECT r, {SPANS} AS spans, {SPANS} FILTER (rank IN ({", ".join(map(str, BASE))})) AS base,
  {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in BASE.items())} FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE.values())},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)""",
    "op2_quality_rules": rf"""
WITH {WORDS}, {repeats(5, "r, g")},
n AS (SELECT r, count(*) AS n FROM c GROUP BY r),
m AS (SELECT doc_id, text, w, len(w) AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN n USING (r)),
b AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > len(lines) OR word_chars > 25 * n_words OR word_chars < 2 * n_words
    OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))
    OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < n_words
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣●]'))) > 9 * len(lines)
    OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*\z'))) > 3 * len(lines)
    OR (n_words >= 50 AND 2 * length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) > length(text) AND len(list_filter(w, lambda x: lower(x) IN
      ('der', 'die', 'und', 'in', 'von', 'the', 'of', 'and', 'to', 'a', 'de', 'la', 'que', 'el', 'en', 'les', 'et', 'le', 'des', 'un'))) < 2)
    OR (n_words >= 100 AND 5 * len(list_distinct(w)) < n_words)
    OR 2 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > word_chars
    OR regexp_matches(text, '[!-~]{{1000,}}')
    OR (n_words >= 100 AND NOT regexp_matches(text, '[.!?…。！？؟।]'))
    OR contains(lower(text), 'lorem ipsum')
    OR 20 * length(regexp_replace(text, '[^{{}}\[\];=]+', '', 'g')) > length(text)) AS kept FROM b""",
    "op3_substring_dedup": rf"""
WITH {WORDS}, {repeats(35, "g")},
k AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN c USING (r, i) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (r)""",
    "op11_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, text)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 18
    ELSE 23 + length(role) + len(regexp_extract_all(role, '{CONTROL}')) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM o GROUP BY conv_id""",
    "op12_filter_audit": rf"""
WITH k AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS INTEGER) + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER)
    + 16 * coalesce(CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INTEGER), 0) AS mask FROM d LEFT JOIN k USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE (a.b | b.b | c.b | d.b | e.b) = 31),
s AS (SELECT filter_order, i AS step, CAST(bits[i] AS INTEGER) AS own, CAST(coalesce(list_sum(bits[1 : i - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(i)),
q AS (SELECT part, filter_order, step, own, sum(n) FILTER ((mask & (before | own)) = 0) AS kept, coalesce(sum(n) FILTER ((mask & own) <> 0 AND (mask & before) = 0), 0) AS removed,
  sum(n) FILTER ((mask & own) <> 0 AND (mask & before) <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
  sum(good) FILTER ((mask & own) <> 0 AND (mask & before) = 0) AS good_lost, sum(toxic) FILTER ((mask & own) <> 0 AND (mask & before) = 0) AS toxic_lost FROM m, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM q""",
}
