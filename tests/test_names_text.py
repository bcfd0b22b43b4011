import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import encoding as E
from quillmill.functions import names as N
from quillmill.functions import text as X


@pytest.mark.parametrize(
    ("name", "key"),
    [(" Parser ", "parser"), ("Ｐａｒｓｅｒ", "parser"), ("“(Parser)”", "parser"), ("Graph   Model.", "graph model"), ("《文档》", "文档"), ("Straße", "strasse"), (None, ""), ("...", ""), ("`x`", "x")],
)
def test_match_key(name, key):
    assert N.match_key(name) == key


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_match_key_is_stable(s):
    assert N.match_key(N.match_key(s)) in (N.match_key(s), N.match_key(N.match_key(N.match_key(s))))


def test_key_columns(spark):
    df = spark.createDataFrame([("A b", ["a B", "C", None]), (None, None)], "name string, aliases array<string>")
    r = df.select(N.match_key_col("name").alias("k"), N.alias_keys_col("name", "aliases").alias("a"), N.statement_key_col("name").alias("s")).collect()
    assert (r[0].k, r[0].a, r[1].k, r[1].a) == ("a b", ["a b", "c"], "", [])
    assert N.statement_key("It is so。") == "it is so" and N.compact_key("文档 模型") == "文档模型"


def test_ids(spark):
    r = spark.range(1).select(N.knowledge_id(F.lit("entity"), F.lit(" Parser ")).alias("k"), N.document_id(F.lit(" A\\B.md")).alias("d")).first()
    import hashlib

    assert r.k == hashlib.sha1(b"entity:parser").hexdigest()[:16] and r.d == hashlib.sha1(b"a/b.md").hexdigest()[:16]


def test_lines_like_splitlines(spark):
    texts = ["", "a", "a\n", "a\r\nb\x0bc\x0cd\x85e f", "\n\n x \n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.lines(F.col("t")).alias("l"), X.first_line(F.col("t")).alias("f")).collect():
        assert r.l == r.t.splitlines()
        assert r.f == next((x.strip()[:120] for x in r.t.splitlines() if x.strip()), "")


def test_link_targets(spark):
    df = spark.createDataFrame([("[a](b%20c.md) [x](y+z) ![i](p%zz)",)], "t string")
    assert df.select(X.link_targets(F.col("t")).alias("t")).first().t == ["b c.md", "y+z", "p%zz"]


@pytest.mark.parametrize(
    ("data", "text", "enc"),
    [("hé".encode(), "hé", "utf-8"), (b"\xef\xbb\xbfa\r\nb", "a\nb", "utf-8-sig"), ("文".encode("utf-16"), "文", "utf-16"), ("知识库的文档模型和解析器都在这里".encode("gb18030"), "知识库的文档模型和解析器都在这里", "gb18030"), (b"", "", "utf-8")],
)
def test_decode(data, text, enc):
    d = E.decode(data)
    assert (d.text, d.encoding, d.had_errors) == (text, enc, False)


def test_decode_lossy_and_explicit():
    assert E.decode(b"\xff\xff\xff\x80\x81") .text
    assert E.decode("é".encode("cp1252"), "cp1252").text == "é"
