"""DuckDB SQL snippets that several oracles share."""

from __future__ import annotations

BODY = r"regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '<i>', 'g'), '(?s)<!--.*?-->', '<i>', 'g')"
SEGMENTS = f"list_filter(list_transform(regexp_extract_all({BODY}, '>([^<]+)', 1), lambda t: trim(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;', '&'), chr(10), ' '))), lambda t: t <> '')"
TEXTS = "texts AS (SELECT doc_id AS page_id, text FROM documents)"
EMAIL_SQL = r"(?:^|[^\w.+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
