from pyspark.sql import functions as F

from notelake.functions import text, vectors
from notelake.functions.embed import embed_texts
from notelake.operators.extract import split_chunks, tool_calls
from notelake.operators.predicates import glob_regex, split_globs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def array(*values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_quantize(spark):
    assert one(spark, vectors.quantize(array(0, 1, -1))) == [0, 127, -127]
    assert one(spark, vectors.quantize(array(2, -2))) == [127, -127]
    assert one(spark, vectors.quantize(array(0.5))) == [64]
    assert one(spark, vectors.dequantize(vectors.quantize(array(0, 1, -1)))) == [0.0, 1.0, -1.0]


def test_cosine(spark):
    assert one(spark, vectors.cosine(array(1, 0), array(2, 0))) == 1.0
    assert one(spark, vectors.cosine(array(1, 0), array(0, 3))) == 0.0
    assert one(spark, vectors.cosine(array(1, 0), array(-1, 0))) == -1.0
    assert one(spark, vectors.cosine(array(0, 0), array(1, 1))) == 0.0
    assert one(spark, vectors.cosine(array(1, 1, 9), array(1, 1))) > 0.999
    a, b = array(0.1, -0.4, 0.3, 0.8), array(0.2, -0.1, 0.7, 0.5)
    assert abs(one(spark, vectors.cosine(a, b)) - one(spark, vectors.cosine(vectors.quantize(a), vectors.quantize(b)))) < 0.03


def test_is_numeric(spark):
    assert one(spark, vectors.is_numeric(array(1, 2)))
    assert not one(spark, vectors.is_numeric(F.array(F.lit(1.0), F.lit(float("nan")))))
    assert not one(spark, vectors.is_numeric(F.array(F.lit(1.0), F.lit(float("inf")))))
    assert not one(spark, vectors.is_numeric(F.lit(None).cast("array<double>")))


def test_query_text(spark):
    assert one(spark, text.refine_query(F.lit("Tell me about the Müller case??"))) == "the müller case"
    assert one(spark, text.search_terms(F.lit('find "Big Cat" of x'))) == ['"big', 'cat"']
    assert one(spark, text.quoted_terms(F.lit('find "Él Gato" of x'))) == ["el gato"]
    assert one(spark, text.tag_key(F.lit("País  del_ _Sur"))) == "pais_del_sur"
    assert one(spark, text.model_prefix(F.lit("nomic-v1"), "document")) == "search_document: "
    assert one(spark, text.safe_name(F.lit('??'))) == "Concept"


def test_front_matter_field(spark):
    body = "x" * 60
    has = text.set_front_matter_field(F.lit(f"---\na: 1\nb: $1\n---\n{body}"), "b", F.lit('q"$2'))
    assert one(spark, has) == f'---\na: 1\nb: "q\\"$2"\n---\n{body}'
    assert one(spark, text.set_front_matter_field(F.lit(f"---\na: 1\n---\n{body}"), "b", F.lit("v"))) == f'---\na: 1\nb: "v"\n---\n{body}'
    assert one(spark, text.set_front_matter_field(F.lit(body), "b", F.lit("v"))) == f'---\nb: "v"\n---\n{body}'
    assert one(spark, text.set_front_matter_field(F.lit("short"), "b", F.lit("v"))) == "short"


def test_chunks():
    for words in (1, 40, 400, 3000):
        t = " ".join(f"word{i}{'.' if i % 9 == 0 else ''}" for i in range(words))
        got = list(split_chunks(t, 1000, 150))
        assert [c for *_, c in got] == [t[a:b].strip() for a, b, _ in got]
        assert got[-1][1] == len(t) and got[0][0] == 0
        assert all(x[0] < y[0] <= x[1] for x, y in zip(got, got[1:], strict=False))
    assert list(split_chunks("", 10, 2)) == []


def test_globs():
    import re

    assert split_globs("a/*.md, {b,c}/**\n d ") == ["a/*.md", "{b,c}/**", "d"]
    assert re.match(glob_regex("a/**/x.md"), "a/x.md") and re.match(glob_regex("a/**/x.md"), "a/b/c/x.md")
    assert not re.match(glob_regex("a/*.md"), "a/b/c.md") and re.match(glob_regex("{b,c}/**"), "c/.dot/x")


def test_tool_calls(spark):
    rows = [(1, '<call:a>{"x": "}"}</call> <call:b>{"y": {}} </call><call:c>{bad}</call><call:d>{"z": 1}'), (2, None)]
    got = tool_calls(spark.createDataFrame(rows, "id long, content string"), ["id"]).orderBy("ord").collect()
    assert [(r.skill, r.params, r.problem) for r in got] == [("a", '{"x": "}"}', None), ("b", '{"y": {}}', None), ("c", "{bad}", "bad json"), ("d", None, "not closed")]


def test_embed_fallback():
    calls = []

    def model(texts):
        calls.append(len(texts))
        if len(texts) > 1 or len(texts[0]) > 400:
            raise ValueError("too much")
        return [[1.0, 2.0] for _ in texts]

    size = [3]
    assert embed_texts(["a\0b", "c" * 900], model, size) == [[1.0, 2.0], [1.0, 2.0]]
    assert size == [2]

    def broken(texts):
        raise ValueError("never")

    assert embed_texts(["a"], broken, [3]) == [[0.0, 0.0, 0.0]]
