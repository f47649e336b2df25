"""Line-first quality rules, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; lines that fail are removed, and a document that
loses too much of its text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import SPACE, free_name, others, table

WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"
#: A line that says one of these (English, German, Spanish, French) is boilerplate if it is short.
BOILERPLATE = r"(?iu)\b(cookies? (policy|settings|consent)|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|sign (in|up) (to|for)|log ?in to|subscribe to our|share (this|on) |click here|read more|back to top|powered by|alle rechte vorbehalten|datenschutzerklärung|impressum|cookie-einstellungen|nutzungsbedingungen|weiterlesen|hier klicken|nach oben|todos los derechos reservados|política de (privacidad|cookies)|aviso legal|leer más|haz clic|iniciar sesión|volver arriba|tous droits réservés|politique de confidentialité|mentions légales|conditions d'utilisation|lire la suite|cliquez ici|haut de page)\b"
#: A line of separated labels, such as Home | News | Contact, or a trail of arrows.
NAVIGATION = r"^[^.!?]{1,40}(\s*[|»›>•·/]\s*[^.!?|»›>•·/]{1,40}){2,}$"
#: Marks repeated (!!, ??, %%%, ***) and runs of symbols are no punctuation of prose.
NOISE = r"[!?]{2,}|[#*$%&|<>]{2,}|(?<=\s)\|(?=\s|$)"
ENDS = r"[.!?…:;,。！？]['\"”’»)\]]*$"


def line_fails(line: Column) -> Column:
    """One boolean for a line; lines without a word never fail."""
    words = F.size(F.split(F.btrim(line, F.lit(WHITE)), SPACE))
    ends = F.right(F.rtrim(line, F.lit(WHITE)), F.lit(4)).rlike(ENDS)
    noise = F.regexp_count(line, F.lit(NOISE)) * 5 > words
    unpunctuated = ~ends & (words >= 12) & ~line.rlike(r"[.!?;:,]")
    navigation = (words <= 40) & line.rlike(NAVIGATION)
    boilerplate = (words <= 30) & line.rlike(BOILERPLATE)
    return line.rlike(WORD) & (noise | unpunctuated | navigation | boilerplate)


def judge(docs: DataFrame, text: str = "text", window: int = 8, least_words: int = 20, most_repeated: int = 30, least_kept: float = 0.5) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept_chars (long), base_failed, kept
    (boolean) and cleaned (string: the lines that don't fail).

    A null text has no words, fails the base and stays null in cleaned. Columns of docs with these names are replaced.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars", "base_failed", "kept", "cleaned"]
    own = others(docs, *new)
    w, l, k, h, s, p = (free_name(x, docs) for x in ("__w", "__l", "__k", "__h", "__s", "__p"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    with_word = F.filter(lines, lambda x: x.rlike(WORD))
    chars = lambda c: F.char_length(F.translate(c, WHITE, "")).cast("long")
    one = docs.select(*own, F.filter(F.split(t, SPACE), lambda x: x != "").alias(w), with_word.alias(l), F.filter(lines, lambda x: ~line_fails(x)).alias(k))
    two = one.select(
        *own,
        F.size(w).cast("long").alias("n_words"),
        chars(t).alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
        F.when(F.col(text).isNotNull(), F.array_join(k, "\n")).alias("cleaned"),
        F.when(F.size(w) < window, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])))
        .alias(h),
    )
    # Windows by hash and place; only documents in which a hash repeats are sorted at all.
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    three = two.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), pairs))
    twin = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
    four = three.withColumn(p, F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"])))
    cover = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)
    five = four.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).withColumn("kept_chars", chars(F.coalesce("cleaned", F.lit(""))))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    six = five.withColumn("base_failed", failed)
    six = six.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= least_kept * F.col("word_chars")))
    # A filter on the verdict would be pushed below and multiply the nested expressions; it can't pass a generator.
    return six.select(*own, F.inline(F.array(F.struct(*new))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base figures and the verdict of the line rules."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_chars")


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 8)),
two AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8) AS step FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(step, 8))::BIGINT AS n FROM two GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS l FROM w),
lc AS (SELECT doc_id, l, len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
bad AS (SELECT doc_id, l, (len(regexp_extract_all(l, '[!?]{2,}|[#*$%&|<>]{2,}')) + len(regexp_extract_all(replace(l, ' | ', ' |  '), '(^|[\x20\x09-\x0D])\|([\x20\x09-\x0D]|$)')) - (CASE WHEN starts_with(l, '|') THEN 1 ELSE 0 END)) * 5 > n
  OR (NOT regexp_matches(right(rtrim(l, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 4), '[.!?…:;,。！？][''"”’»)\]]*$') AND n >= 12 AND NOT regexp_matches(l, '[.!?;:,]'))
  OR (n <= 40 AND regexp_matches(l, '^[^.!?]{1,40}(\s*[|»›>•·/]\s*[^.!?|»›>•·/]{1,40}){2,}$'))
  OR (n <= 30 AND regexp_matches(l, '(?i)\b(cookies? (policy|settings|consent)|privacy policy|terms of (use|service)|all rights reserved|enable javascript|lorem ipsum|sign (in|up) (to|for)|log ?in to|subscribe to our|share (this|on) |click here|read more|back to top|powered by|alle rechte vorbehalten|datenschutzerklärung|impressum|cookie-einstellungen|nutzungsbedingungen|weiterlesen|hier klicken|nach oben|todos los derechos reservados|política de (privacidad|cookies)|aviso legal|leer más|haz clic|iniciar sesión|volver arriba|tous droits réservés|politique de confidentialité|mentions légales|conditions d''utilisation|lire la suite|cliquez ici|haut de page)\b')) AS f FROM lc),
kc AS (SELECT doc_id, sum(CASE WHEN f THEN 0 ELSE length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) END)::BIGINT AS k FROM bad GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(k, 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN kc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_chars >= 0.5 * word_chars AS kept, kept_chars FROM b
"""
