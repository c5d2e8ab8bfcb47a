"""DuckDB fragments that several oracles share."""

from __future__ import annotations

TEST_REPOS = 4

FILES = "files AS (SELECT doc_id AS file_id, source AS repo, lang, lang || '/' || lpad(doc_id::VARCHAR, 9, '0') AS path, text FROM documents)"

FOLDS = f"""folds AS (SELECT repo, place, CASE WHEN place <= {TEST_REPOS} THEN 'test' WHEN (place - {TEST_REPOS}) % 3 = 0 THEN 'rank' ELSE 'lm' END AS fold
    FROM (SELECT source AS repo, row_number() OVER (ORDER BY substr(md5(source), 1, 8), source) AS place FROM (SELECT DISTINCT source FROM documents)))"""


def draw(key: str, salt: str) -> str:
    """Integer in [0, 2^60)."""
    return f"CAST('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


def unit(key: str, salt: str) -> str:
    return f"(CAST({draw(key, salt)} AS DOUBLE) / 1152921504606846976.0)"
