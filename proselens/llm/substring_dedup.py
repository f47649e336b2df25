"""Substring deduplication over words by super-k-mers.

Consecutive 50-word windows that share a minimiser travel as one packed string to the minimiser's bucket, where
sorting counts the windows exactly (see windows.py for the dealing).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import table
from proselens.llm.windows import remove_repeats, word_units


def sorted_windows(payloads: list[bytes], docs: list[int], size: int) -> list[np.ndarray]:
    """Per string and window the smallest id: windows as rows of word numbers, sorted whole and compared whole."""
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in p.split(b" ")], ">u4") for p in payloads]
    counts = [len(c) - size + 1 for c in coded]
    least = np.empty(sum(counts), np.int64)
    owner = np.repeat(np.array(docs, np.int64), counts)
    # Strings come grouped by minimiser; sort in slices of the first word's number so that memory stays bounded.
    flat = np.concatenate(coded)
    begin = np.concatenate([[0], np.cumsum([len(c) for c in coded])[:-1]])
    start = np.concatenate([b + np.arange(c) for b, c in zip(begin, counts)])
    lead = np.argsort(flat[start], kind="stable")
    step, at = 1 << 16, 0
    while at < len(lead):
        to = min(at + step, len(lead))
        while to < len(lead) and flat[start[lead[to]]] == flat[start[lead[to - 1]]]:
            to += 1
        some = lead[at:to]
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, size)[start[some]]).view(f"V{4 * size}").ravel()
        order = np.argsort(rows)
        rows = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        low = np.minimum.reduceat(owner[some[order]], heads)
        least[some[order]] = np.repeat(low, np.diff(np.append(heads, len(rows))))
        at = to
    return np.split(least, np.cumsum(counts)[:-1])


def dedup(docs: DataFrame, size: int = 50, k: int = 4, **where) -> DataFrame:
    """docs with n_units, n_removed, n_spans and kept (words one space apart); see remove_repeats for edge cases."""
    return remove_repeats(docs, word_units, size, min(k, size), sorted_windows, **where)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: words, words removed, and the digest of what is kept. Null texts have no words."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
low AS (SELECT g, min(doc_id) AS d FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN low USING (g) WHERE low.d < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, (SELECT unnest(generate_series(0, 49)) AS j)),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id)
"""
