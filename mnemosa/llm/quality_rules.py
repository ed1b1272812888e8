"""Line-first cleaning: rules per line, then a limit on what a document may lose.

A line fails if it looks like navigation, boilerplate or bad punctuation; failed
lines are removed, and a document that loses more than MOST_LOST per cent of its
words is rejected.  Two limits on whole documents come first (`base_failed`): too
few words, and too many words in repeated three-word windows.

Every rule reads one line, and every figure one document, so that the operator
is a single pass without a shuffle.

Defined cases: null or wordless text has zero counts, fails the base limit on
words and keeps no line; lines without a word neither fail nor count; repeated
rows get a result each; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import SPACE, U64, Words, mix, pieces, windows

LEAST_WORDS, MOST_REPEATED, MOST_LOST, SHORT_LINE, WORDS_A_SYMBOL = 50, 50, 50, 10, 5
#: The patterns of the rules, for Python's re and for RE2.
SYMBOL = r"[#*$%&|<>]"
LINE_END = r"[.!?:;,…。！？][\"'”’)\]»]*$"
SHOUTED = r"!!|\?\?"
NAVIGATION = r"\|.*\||[›»•·].*[›»•·]|(?i:^ *(home|menu|skip to|next|previous|back to top)\b)"
BOILERPLATE = r"(?i:all rights reserved|cookies?\b|privacy policy|terms of (use|service)|javascript|lorem ipsum|licen[sc]ed under|copyright|©|sign (in|up)\b|log ?in\b|subscribe|click here|read more)"

_is_symbol = np.zeros(256, bool)
_is_symbol[list(b"#*$%&|<>")] = True
_word = re.compile(r"[^\x20\x09-\x0D]+")
_symbol, _line_end = re.compile(SYMBOL), re.compile(LINE_END)
_fails = re.compile(f"{SHOUTED}|{NAVIGATION}|{BOILERPLATE}")
_trim = " \t\n\v\f\r"


def line_fails(line: str, words: int) -> bool:
    """For a trimmed line of so many words, at least one."""
    if words < SHORT_LINE and not _line_end.search(line):
        return True
    return bool(_fails.search(line)) or WORDS_A_SYMBOL * len(_symbol.findall(line)) > words


def clean_text(text: str | None) -> tuple[list[str], int, int]:
    """The lines that stay, the words in those that fail, and the lines with a word equal to an earlier line."""
    kept, lost, seen, repeated, failed = [], 0, set(), 0, {}
    for line in (text or "").split("\n"):
        trimmed = line.strip(_trim)
        if not trimmed:
            kept.append(line)
            continue
        if line in seen:
            repeated += 1
            count = failed[line]
        else:
            seen.add(line)
            n = len(_word.findall(trimmed))
            failed[line] = count = n if line_fails(trimmed, n) else 0
        if count:
            lost += count
        else:
            kept.append(line)
    return kept, lost, repeated


def _in_repeats(words: Words, width: int = 3) -> np.ndarray:
    """Per row the words in windows of three words that the row holds twice or more."""
    n, row = len(words), words.row_of()
    covered = np.zeros(n, bool)
    if n >= width:
        inside = row[: n - width + 1] == row[width - 1 :]
        at = np.flatnonzero(inside)
        h = mix(windows(words.hashes(), width)[at] + row[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        equal = h[order][1:] == h[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][equal]] = True
        again[order[:-1][equal]] = True
        for k in range(width):
            covered[at[again] + k] = True
    return np.diff(np.concatenate([[0], np.cumsum(covered)])[words.bounds])


def rule_figures(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, the figures, base_failed, lost_words and kept; with_text adds clean_text, the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"))
                data, at = words.data, words.offsets
                per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])  # noqa: B023, E731
                done = [clean_text(t) for t in batch.column("text").to_pylist()]
                n, lost = words.counts(), np.array([x for _, x, _ in done], np.int64)
                repeats = _in_repeats(words)
                failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
                kept = ~failed & (100 * lost <= MOST_LOST * n)
                figures = [n, per_row(~SPACE[data] & (data & 0xC0 != 0x80)), per_row(_is_symbol[data]), np.array([x for _, _, x in done]), repeats]
                out = [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in figures), pa.array(failed), pa.array(kept), pa.array(lost)]
                out += [pa.array(["\n".join(x) for x, _, _ in done], pa.string())] * with_text
                yield pa.record_batch(out, names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", *["clean_text"] * with_text]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long" + ", clean_text string" * with_text
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, schema)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {WORDS_SQL.format('text')} AS ws FROM d),
tri AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (SELECT r, line, s, len({WORDS_SQL.format('s')}) AS n FROM lines WHERE s <> ''),
per AS (SELECT r, count(*) - count(DISTINCT line) AS dup,
  sum(CASE WHEN (n < {SHORT_LINE} AND NOT regexp_matches(s, {_quoted(LINE_END)})) OR regexp_matches(s, {_quoted(SHOUTED)}) OR regexp_matches(s, {_quoted(NAVIGATION)})
    OR regexp_matches(s, {_quoted(BOILERPLATE)}) OR {WORDS_A_SYMBOL} * len(regexp_extract_all(s, '{SYMBOL}')) > n THEN n ELSE 0 END) AS lost FROM judged GROUP BY r),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS lost_words
  FROM w LEFT JOIN rep USING (r) LEFT JOIN per USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * lost_words <= {MOST_LOST} * n_words AS kept, lost_words
FROM f
"""
