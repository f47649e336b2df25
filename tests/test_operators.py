from collections import Counter

import pytest

from proselens.operators import stats, store, style
from proselens.plans import registry

A = "# 第1章 起风\n\n“你来了？”他走进门，笑了笑。“外面很冷！”\n\n---\n\n她没有说话，只是看着红色的灯。3天后，他又来了。当天夜里下雨……"
B = "不仅写得快，而且写得好。虽然难读，但是好看。节奏太慢。"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, A), (2, B), (3, "")], "doc_id long, text string")


def test_counts(docs):
    a, b, _ = stats.count_chapter(docs).orderBy("doc_id").collect()
    assert (a.chinese_chars, a.total_chars, a.paragraphs, a.dialogue_lines) == (43, 65, 3, 2)
    assert (b.chinese_chars, b.total_chars, b.paragraphs, b.dialogue_lines) == (22, 27, 1, 0)


def test_sentences_and_templates(docs):
    a, b, _ = style.sentence_shape(docs).orderBy("doc_id").collect()
    assert a.sentence_count == 6 and a.avg_sentence_len == pytest.approx(10.666666666666666) and a.sentence_len_cv == pytest.approx(0.5457577873929057)
    assert a.repetition_score == pytest.approx(0.5078643578643579) and b.repetition_score == pytest.approx(0.6313131313131313)
    assert style.structures(docs).where("doc_id = 2").first().structure_patterns == "not_only_but_also,although_but"


def test_phrases(spark):
    text = "天地玄黄宇宙洪荒" * 3 + "日月" + "天地玄黄" * 2
    got = style.phrases(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    k = sum(c >= 3 for c in Counter(text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)).values())
    assert got.repeated_phrase_count == min(50, k) and got.phrase_repetition_score == min(20, k) * 5


def test_graph(spark):
    e = spark.createDataFrame([("b", "a", 2), ("a", "b", 3), ("c", "a", 1)], "a string, b string, weight int")
    assert {(r.a, r.b, r.weight) for r in store.graph(e).collect()} == {("a", "b", 5), ("a", "c", 1)}


def test_graph_of_orders_is_whole(spark):
    """Every pair of suppliers of an order counts, in both orientations."""
    orders, d = {}, "/root/testdata/sf0.001"
    for r in spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        orders.setdefault(r.l_orderkey, set()).add(r.l_suppkey)
    edges, degree = Counter(), Counter()
    for s in orders.values():
        for a in s:
            for b in s - {a}:
                edges[min(a, b), max(a, b)] += 1
                degree[a] += 1
                degree[b] += 1
    assert {(r.a, r.b): (r.weight, r.times) for r in registry.QUERIES["bb05_graph"](spark, d).collect()} == {k: (n, n) for k, n in edges.items()}
    assert {r.node: r.degree for r in registry.QUERIES["bb05_degrees"](spark, d).collect()} == degree
