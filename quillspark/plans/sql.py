"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

WS = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PUNCTUATION = r"""[.`~!@#$%^&*(){}\[\]\\|:;'",<>/?-]""".replace("'", "''")
HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
PAGE = "lpad(page_id::VARCHAR, 10, '0') || '.html'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    bare = f"regexp_replace({trim(f'lower({x})')}, '{PUNCTUATION}', '', 'g')"
    return trim(f"regexp_replace({bare}, '{WS}{{2,}}', ' ', 'g')")


def strip_tags(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?-->|<[^>]*>', '', 'g')"


def hide(x: str) -> str:
    for tag in ("script", "style", "noscript", "title"):
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    return x


def body_text(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({hide(x)}, '(?s)<!--.*?-->', '', 'g'), '(?i)<br\b[^>]*>|</?p\b[^>]*>', chr(10), 'g')"
    x = strip_tags(x)
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{value}')"
    return x


#: toks: lang, doc_id, location, term of the documents' words.
TOKS = f"""
words AS (SELECT coalesce(lower(lang), 'unknown') AS lang, doc_id, string_split_regex(text, '{WS}+') AS w FROM documents),
toks AS (
  SELECT * FROM (SELECT lang, doc_id, (generate_subscripts(w, 1) - 1)::INTEGER AS location, unnest(w) AS word FROM words) AS x
  CROSS JOIN LATERAL (SELECT {norm('word')} AS term) WHERE term <> ''
)"""

#: asked: query_id, ordinal, term, n_terms: the first two distinct terms' words of each benchmark text.
ASKED = f"""
asked_terms AS (
  SELECT item_id AS query_id, list_distinct_ordered AS terms FROM (
    SELECT item_id, [x FOR x, i IN ws IF list_position(ws, x) = i] AS list_distinct_ordered
    FROM (SELECT item_id, [x FOR x IN string_split_regex({norm("array_to_string(string_split_regex(text, '" + WS + "+')[1:2], ' ')")}, '{WS}+') IF x <> ''] AS ws FROM benchmark))
), asked AS (
  SELECT query_id, generate_subscripts(terms, 1) - 1 AS ordinal, unnest(terms) AS term, len(terms) AS n_terms FROM asked_terms
)"""

#: The same of whole texts.
ASKED_WHOLE = ASKED.replace(norm("array_to_string(string_split_regex(text, '" + WS + "+')[1:2], ' ')"), norm("text"))

#: hits: query_id, doc_id, score.
HITS = f"""{TOKS}, {ASKED},
postings AS (SELECT lang, term, doc_id, count(*) AS tf FROM toks GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS length FROM postings GROUP BY ALL),
df AS (SELECT lang, term, count(*) AS df FROM postings GROUP BY ALL),
corpus AS (SELECT lang, count(*) AS n_docs, avg(length) AS mean_length FROM (SELECT lang, doc_id, sum(tf) AS length FROM postings GROUP BY ALL) GROUP BY ALL),
hits AS (
  SELECT query_id, doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))) AS score
  FROM postings JOIN asked USING (term) JOIN df USING (lang, term) JOIN corpus USING (lang) JOIN lengths USING (doc_id)
  GROUP BY query_id, doc_id HAVING count(DISTINCT ordinal) = max(n_terms)
)"""


def whole(text: str) -> str:
    """An oracle over the first two words of each text, over whole texts."""
    assert ASKED in text
    return text.replace(ASKED, ASKED_WHOLE)
