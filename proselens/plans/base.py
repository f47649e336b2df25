"""What the queries' SQL has in common: the documents in Chinese characters and expressions over their text t."""

from __future__ import annotations

from proselens.functions import fixed_values as V
from proselens.sources.tables import CHINESE, LATIN

HAN = "[一-鿿]"
WIDE = "[一-鿿㐀-䶿豈-﫿]"

H = f"h AS (SELECT doc_id, source AS book, translate(lower(replace(text, chr(10), chr(10) || chr(10))), '{LATIN}', '{CHINESE}') AS t FROM documents)"
STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
SENT = lambda n: rf"list_filter(list_transform(regexp_split_to_array({STRIP('t')}, '[。！？…]+'), lambda x: {STRIP('x')}), lambda x: length(x) > {n})"
PARA = rf"list_filter(list_transform(regexp_split_to_array(t, '\n\s*\n'), lambda x: {STRIP('x')}), lambda x: length(x) > 5)"
N = lambda p, c="t": f"len(regexp_extract_all({c}, '{p}'))"
COUNT = lambda w, c="t": f"((length({c}) - length(replace({c}, '{w}', ''))) // {len(w)})"
CHAP = "c AS (SELECT h.*, row_number() OVER (PARTITION BY book ORDER BY doc_id) AS chapter_no FROM h)"
DIV = f"cs AS (SELECT doc_id, unnest(regexp_extract_all(t, '{HAN}')) AS c FROM h), cg AS (SELECT doc_id, c, count(*) AS n FROM cs GROUP BY ALL), dv AS (SELECT h.doc_id, coalesce(sum(n), 0)::BIGINT AS words, count(c)::DOUBLE / greatest(coalesce(sum(n), 0), 1) AS ttr, (count(*) FILTER (n = 1))::DOUBLE / greatest(coalesce(sum(n), 0), 1) AS hapax_ratio FROM h LEFT JOIN cg USING (doc_id) GROUP BY h.doc_id)"
SHAPE = f"ss AS (SELECT doc_id, list_transform({SENT(1)}, lambda x: length(x)) AS s FROM h), sq AS (SELECT doc_id, len(s) AS n, coalesce(list_sum(s), 0) AS a, coalesce(list_sum(list_transform(s, lambda x: x * x)), 0) AS q, s FROM ss), sh AS (SELECT doc_id, n::INT AS sentence_count, a::DOUBLE / greatest(n, 1) AS avg_sentence_len, CASE WHEN n < 2 THEN 0 ELSE sqrt((q * n - a * a)::DOUBLE) / a END AS sentence_len_cv, CASE WHEN n < 2 THEN 0 ELSE list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, n), lambda i: least(s[i], s[i + 1])::DOUBLE / greatest(s[i], s[i + 1]))), lambda x, y: x + y) / greatest(n - 1, 1) END AS repetition_score FROM sq)"
STRUCT = "st AS (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in V.STRUCTURES.items()) + "], lambda x: x IS NOT NULL) AS f FROM h)"
GRAM = lambda n: f"list_transform(range(1, greatest(len(c) - {n - 2}, 1)), lambda i: {' || '.join(f'c[i + {k}]' for k in range(n))})"
PHR = f"j AS (SELECT doc_id, string_split(array_to_string(regexp_extract_all(t, '{HAN}+'), ''), '') AS c FROM h), gr AS (SELECT doc_id, unnest(list_concat(list_concat({GRAM(3)}, {GRAM(4)}), {GRAM(5)})) AS g FROM j), gk AS (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, g FROM gr GROUP BY ALL HAVING count(*) >= 3) GROUP BY doc_id), ph AS (SELECT h.doc_id, least(50, coalesce(k, 0))::INT AS repeated_phrase_count, (least(20, coalesce(k, 0)) * 5)::INT AS phrase_repetition_score FROM h LEFT JOIN gk USING (doc_id))"
CUT = lambda x: f"greatest(0, least(100, trunc({x})::INT))"
DENSE = f"greatest({N(HAN)}, 1)::DOUBLE"
