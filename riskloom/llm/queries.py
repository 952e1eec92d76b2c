"""The corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from riskloom.llm.ann import op10_nearest
from riskloom.llm.bpe import op2_bpe
from riskloom.llm.chat import op5_chat
from riskloom.llm.decontam import op9_decontamination
from riskloom.llm.lm_scoring import op1_lm_scoring
from riskloom.llm.quality import op7_quality
from riskloom.llm.simhash import op3_simhash
from riskloom.llm.toxicity import op6_toxicity
from riskloom.llm.url_rules import op4_url_filters
from riskloom.llm.warc import op8_warc

QUERIES = (
    op1_lm_scoring, op2_bpe, op3_simhash, op4_url_filters, op5_chat,
    op6_toxicity, op7_quality, op8_warc, op9_decontamination, op10_nearest,
)


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Turns in order; control strings in a text cost one backslash each.
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
 t AS (SELECT *, len(regexp_extract_all(text, '{marks}')) AS marks, len(regexp_extract_all(role, '{marks}')) AS role_marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(text) + marks + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 23 + length(role) + role_marks END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""".replace("{marks}", r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|role\|>|<\|text\|>|<\|end\|>")

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
 d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS latest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST(((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < latest THEN latest END AS refers_to
FROM d"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
 iz AS (SELECT item_id, w, least(13, len(w)) AS m FROM iw WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM iz)),
 pos AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win))),
 hit AS (SELECT doc_id, i, m, item_id FROM pos JOIN win USING (m, s)),
 covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(covered.n, 0) > 0 AND 20 * coalesce(covered.n, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The other queries rest on hashes, merges, models or estimates that SQL
    has no words for; their tests hold them against brute force."""
    return {"op5_chat": CHAT_SQL, "op8_warc": WARC_SQL, "op9_decontamination": DECONTAMINATION_SQL}
