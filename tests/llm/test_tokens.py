import random

import public_tokenizers
import sentencepiece

from proselens.llm.sentencepiece_codec import decode, encode, tables
from proselens.llm.token_counts import count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    r = random.Random(4)
    letters = ["a", "e", "th", "ing", "n", "é", "ß", "日", "本", "🙂", " ", " ", "\n", "\t", "▁", "x", "0", "1", "!!", "\x00", "ﬁ", "<s>", "of ", "\r\n", "   "]
    out = [None, "", " ", "\n", "  \n ", "a" * 500, "ab " * 300, " " * 100 + "x", "x" + " " * 33, "e" * 1001, "\n\n\nword", "<s>x</s>"]
    out += ["".join(r.choice(letters) for _ in range(r.randrange(1, 80))) for _ in range(400)]
    out += ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCD ") for _ in range(200)) for _ in range(60)]
    out += [" ".join(LIB.id_to_piece(r.randrange(300, 32000)).replace("▁", " ") for _ in range(40)) for _ in range(60)]
    return out


def test_counts_and_ids_are_the_librarys(spark):
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts())]
    docs += docs[:3]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, bucket int")
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(LIB.encode(t or ""))) for i, t in docs)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(df, MODEL).collect()) == want
    coded = encode(df, MODEL).collect()
    key = lambda x: (x[0], x[1])
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.ids, r.decoded) for r in coded), key=key) == sorted(((-1 if i is None else i, LIB.encode(t or ""), (t or "").replace("▁", " ")) for i, t in docs), key=key)
    small = encode(df, MODEL, most=300, memo=50)  # many batches, and a memo that is cleared again and again
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.ids, r.decoded) for r in small.collect()), key=key) == sorted(((-1 if r.doc_id is None else r.doc_id, r.ids, r.decoded) for r in coded), key=key)
    assert all(r.text == r.decoded for r in decode(small, MODEL).collect())
    assert count_tokens(df.limit(0), MODEL).collect() == encode(df.limit(0), MODEL).collect() == []


def test_every_piece_and_pair():
    p = tables(MODEL)
    r = random.Random(9)
    words = {p.text[i].lstrip("▁") for i in range(259, 32000)} | {p.text[r.randrange(259, 32000)].lstrip("▁") + p.text[r.randrange(259, 32000)].replace("▁", "") for _ in range(30000)}
    words = sorted("▁" + w for w in words if w and "\n" not in w)
    assert p.encode(words) == [LIB.encode(w[1:]) for w in words]


def test_batches_give_the_same_ids():
    """Pre-tokens indexed one at a time, a few at a time and all at once have the same ids."""
    from proselens.llm.pretokens import cut
    from proselens.llm.sentencepiece_codec import tables

    words = list(dict.fromkeys(cut("Der Tag war lang,  und die Straße lag leer. naïve 漢字 x" + "a" * 50 + "\n\nL'été arrive")))
    p = tables(public_tokenizers.path("piece_bpe_32k.model"))
    assert p.encode_pretokens(words, 1) == p.encode_pretokens(words, 20) == p.encode_pretokens(words)
