"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

Only a pre-token's number of pieces is kept; no document's ids are ever made.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import table
from proselens.llm.pretokens import MARK, cut, exchange, unpack


@lru_cache(2)
def library(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def pieces(words: list[str], model: str) -> np.ndarray:
    """How many pieces each pre-token has. The library puts a mark before what it is given: a mark is left out for it,
    and words without one stand after a newline, which with its mark makes two pieces more."""
    marked = [w[1:] if w[0] == MARK else "\n" + w for w in words]
    ids = library(model).encode(marked, num_threads=1)
    return np.array([1 if w == MARK else len(x) if w[0] == MARK else len(x) - 2 for w, x in zip(words, ids)], np.int64)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of docs(doc_id, text). A null text is empty and has no tokens."""

    def send(texts):
        numbers: dict[str, int] = {}
        which, doc, freq = [], [], []
        for d, t in enumerate(texts):
            c = Counter(cut(t))
            which.extend([numbers.setdefault(w, len(numbers)) for w in c])
            freq.extend(c.values())
            doc.extend(repeat(d, len(c)))
        which, doc, freq = np.array(which, np.int64), np.array(doc, "<u2"), np.array(freq, np.int64)
        # One byte a frequency; what is over 255 becomes further entries of the same pair.
        parts = np.maximum(-(-freq // 255), 1)
        which, doc = np.repeat(which, parts), np.repeat(doc, parts)
        rest = np.full(len(which), 255, np.uint8)
        rest[np.cumsum(parts) - 1] = freq - 255 * (parts - 1)
        freq = rest
        order = np.argsort(which, kind="stable")
        heads = np.searchsorted(which[order], np.arange(len(numbers) + 1))
        doc, freq = doc[order], freq[order]

        def payload(some):
            n = heads[some + 1] - heads[some]
            take = np.repeat(heads[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            return n.astype("<u4").tobytes(), doc[take].tobytes(), freq[take].tobytes()

        return list(numbers), payload, (np.array([len(t.encode()) for t in texts], "<i8").tobytes(), b"", b"")

    def work(rows):
        words = [unpack(r["sizes"], r["texts"]) for r in rows]
        known = list({w for ws in words for w in ws})
        n = dict(zip(known, pieces(known, model).tolist())) if known else {}
        for r, ws in zip(rows, words):
            each = np.repeat(np.array([n[w] for w in ws], np.int64), np.frombuffer(r["a"], "<u4"))
            doc = np.frombuffer(r["b"], "<u2")
            total = np.bincount(doc, each * np.frombuffer(r["c"], np.uint8))
            some = np.flatnonzero(total)
            r["keys"] = b""
            yield some.astype("<u2").tobytes(), total[some].astype("<i8").tobytes(), b""

    def join(ids, own, rows):
        total = np.zeros(len(ids), np.int64)
        for r in rows:
            total[np.frombuffer(r["a"], "<u2")] += np.frombuffer(r["b"], "<i8")
        return pa.table([pa.array(ids, pa.int64()), pa.array(np.frombuffer(own["a"], "<i8")), pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    return exchange(docs, send, work, join, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under piece_bpe_32k.model."""
    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)
