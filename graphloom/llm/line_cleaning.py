"""Operator 1: line-first cleaning. Each line is judged by punctuation, navigation and boilerplate rules, failing
lines go, and a document that loses too much of its text, or was poor as a whole, is rejected.

One pass over the texts, no shuffle: a row's result depends on its text alone.

Empty cases: a null or empty text has no words, fails the base rules and is not kept; its clean text is null or
empty. Repeated rows give a result row each. Rows keep their other columns, whatever their names; the columns added
are those of ``ADDED`` (a table that already has one of these names is refused).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from graphloom.llm.words import Words, mix, shingles, steps

#: A line ends a sentence.
ENDS = r"""[.!?…。！？:;]["'»”’)\]]*[ \t\r]*$"""
#: A menu or a table row without a sentence.
NAVIGATION = r"(\|[^|]*\|)|( (>|»|·|•) .* (>|»|·|•) )"
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|privacy policy|terms of (use|service)|cookies? (policy|settings)|accept cookies|"
    r"subscribe to|sign (in|up)|log ?in|click here|enable javascript|copyright (©|\(c\)|[0-9]{4}))"
)
SYMBOLS = r"[#*$%&|<>]"
#: Symbols per hundred characters of a line, and capitals per hundred letters, from which a line fails.
MOST_SYMBOLS = 8
MOST_CAPITALS = 60
LEAST_LETTERS = 10
#: Words of a hundred that a document has to keep, and words at least.
LEAST_KEPT = 70
LEAST_WORDS = 20
MOST_REPEATED = 30
WINDOW = 8

ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed_lines", "kept_words", "base_failed", "kept", "clean_text"]


def failing_lines(lines: pa.Array) -> np.ndarray:
    """Which lines with a word fail a rule."""
    length = pc.utf8_length(lines).to_numpy()
    letters = pc.count_substring_regex(lines, r"\p{L}").to_numpy()
    capitals = pc.count_substring_regex(lines, r"\p{Lu}").to_numpy()
    symbols = pc.count_substring_regex(lines, SYMBOLS).to_numpy()
    match = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    shouting = (letters >= LEAST_LETTERS) & (100 * capitals > MOST_CAPITALS * letters)
    return ~match(ENDS) | match(NAVIGATION) | match(BOILERPLATE) | (100 * symbols > MOST_SYMBOLS * length) | shouting


def _sums(per_byte: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeat_words(words: Words) -> np.ndarray:
    """Words that lie in a window of eight words found twice or more in the text."""
    grams, at = shingles(words.hashes(), words.offsets, WINDOW)
    n = words.counts()
    if not len(grams):
        return np.zeros(len(n), np.int64)
    text = np.repeat(np.arange(len(n)), np.diff(at))
    key = grams ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.starts) + 1, np.int64)
    first = words.offsets[text] + np.arange(len(key)) - at[text]
    np.add.at(edge, first[twice], 1)
    np.add.at(edge, first[twice] + WINDOW, -1)
    return _sums(np.cumsum(edge[:-1]) > 0, words.offsets)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``ADDED``: base counts, verdicts and ``clean_text`` without the failing lines.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words in repeated windows.
    ``kept``: not ``base_failed``, and the lines that pass hold at least 70 % of the words and 20 words.
    Lines without a word are no text: they neither fail nor count, and stay.
    """
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in ADDED[:-3]], *[StructField(c, BooleanType()) for c in ADDED[-3:-1]], StructField("clean_text", StringType())])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError(f"the table has a column named as one of {ADDED}")

    def judge(batches):
        for step in steps(batches):
            text = step.column("text")
            n = len(text)
            words = Words(text)
            n_words = words.counts()
            letter = (words.data & 0xC0) != 0x80
            inside = np.zeros(len(words.data) + 1, np.int8)
            np.add.at(inside, words.starts, 1)
            np.add.at(inside, words.ends, -1)
            word_chars = _sums(letter & (np.cumsum(inside[:-1]) > 0), words.text_at)
            n_symbols = _sums(np.isin(words.data, np.frombuffer(b"#*$%&|<>", np.uint8)), words.text_at)
            n_repeat = _repeat_words(words)

            split = pc.split_pattern(pc.fill_null(text, ""), "\n")
            lines, line_text = split.flatten(), pc.list_parent_indices(split).to_numpy()
            size = Words(lines).counts()
            code = pc.dictionary_encode(lines).indices.to_numpy().astype(np.int64)
            _, first = np.unique(line_text * (code.max(initial=0) + 1) + code, return_index=True)
            again = np.ones(len(lines), bool)
            again[first] = False
            per_text = lambda x: np.bincount(line_text, weights=x, minlength=n).astype(np.int64)
            full = size > 0
            failed = failing_lines(lines) & full
            kept_words = per_text(size * ~failed)
            base_failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
            kept = ~base_failed & (100 * kept_words >= LEAST_KEPT * n_words) & (kept_words >= LEAST_WORDS)
            stay = lines.filter(pa.array(~failed))
            at = np.concatenate([[0], np.cumsum(per_text(~failed))]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), stay), "\n")
            cleaned = pc.if_else(text.is_valid(), joined, pa.scalar(None, joined.type)).cast(pa.string())
            columns = [n_words, word_chars, n_symbols, per_text(again & full), n_repeat, per_text(full), per_text(failed), kept_words]
            arrays = [*step.columns, *[pa.array(x, pa.int64()) for x in columns], pa.array(base_failed), pa.array(kept), cleaned]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return docs.mapInArrow(judge, schema)


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS t, COALESCE(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
),
l AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS size, n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM d)
),
f AS (
  SELECT *, NOT regexp_matches(line, '{ENDS.replace("'", "''")}') OR regexp_matches(line, '{NAVIGATION}') OR regexp_matches(line, '{BOILERPLATE}')
    OR 100 * len(regexp_extract_all(line, '{SYMBOLS}')) > {MOST_SYMBOLS} * length(line)
    OR (len(regexp_extract_all(line, '\\p{{L}}')) >= {LEAST_LETTERS} AND 100 * len(regexp_extract_all(line, '\\p{{Lu}}')) > {MOST_CAPITALS} * len(regexp_extract_all(line, '\\p{{L}}'))) AS failed,
    row_number() OVER (PARTITION BY r, line ORDER BY n) > 1 AS again
  FROM l WHERE size > 0
),
a AS (
  SELECT r, count_if(again) AS n_dup_lines, COUNT(*) AS n_lines, count_if(failed) AS n_failed_lines, SUM(CASE WHEN failed THEN 0 ELSE size END)::BIGINT AS kept_words FROM f GROUP BY r
),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
k AS (SELECT r, i, COUNT(*) OVER (PARTITION BY r, gram) AS c FROM g),
x AS (SELECT r, COUNT(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM k WHERE c > 1) GROUP BY r),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    COALESCE(n_dup_lines, 0)::BIGINT AS n_dup_lines, COALESCE(x.n, 0)::BIGINT AS n_repeat_words, COALESCE(n_lines, 0)::BIGINT AS n_lines,
    COALESCE(n_failed_lines, 0)::BIGINT AS n_failed_lines, COALESCE(kept_words, 0)::BIGINT AS kept_words
  FROM d LEFT JOIN a USING (r) LEFT JOIN x USING (r)
),
c AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND 100 * kept_words >= {LEAST_KEPT} * n_words AND kept_words >= {LEAST_WORDS} AS kept FROM c
"""
