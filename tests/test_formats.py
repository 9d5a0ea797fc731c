"""Rewritten markup, streams of records, translation, variants and search helpers."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import sequence as N
from lamina.functions import text as T
from lamina.operators import format as W
from lamina.operators import match as M
from lamina.operators import search as Q
from lamina.operators import tables as B
from lamina.operators import variants as G
from lamina.sources import markup as K

XML = '<R a="1"  b="2"><N>x  y &lt;b&gt;</N><N/><L>a, b,c.</L><![CDATA[ raw <i> ]]><!-- note --></R>'


def test_styles(spark):
    df = spark.createDataFrame([(1, XML), (2, None)], "rec_id long, xml string")
    got = lambda *a, **k: {r["rec_id"]: r["xml"] for r in W.formatted(df, *a, **k).collect()}
    assert got("compact")[2] is None
    plain = spark.createDataFrame([(1, '<R a="1"><N>x</N><E/></R>')], "rec_id long, xml string")
    styles = {s: W.formatted(plain, s).collect()[0]["xml"] for s in W.STYLES}
    assert styles == {"compact": '<R a="1"><N>x</N></R>', "flush": '<R a="1">\n<N>x</N>\n</R>\n', "indent": '<R a="1">\n  <N>x</N>\n</R>\n', "expand": '<R\n a="1"\n>\n  <N>x</N>\n</R>\n'}
    assert W.formatted(plain, "compact", "<?xml?>", "<!DOCTYPE R>").collect()[0]["xml"].startswith("<?xml?>\n<!DOCTYPE R>\n<R")


@pytest.mark.parametrize(
    "name, action, target, want",
    [
        ("N", "remove", "object", '<R a="1" b="2">\n<L>\na, b,c.\n</L>\n</R>\n'.replace("<L>", "<N/>\n<L>")),
        ("R", "remove", "container", "<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\na, b,c.\n</L>\n"),
        ("N", "decode", "content", '<R a="1" b="2">\n<N>\nx  y <b>\n</N>\n<N/>\n<L>\na, b,c.\n</L>\n</R>\n'),
        ("N", "shrink", "content", '<R a="1" b="2">\n<N>\nx y &lt;b&gt;\n</N>\n<N/>\n<L>\na, b,c.\n</L>\n</R>\n'),
        ("L", "expand", "content", '<R a="1" b="2">\n<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\na\n</L>\n<L>\nb\n</L>\n<L>\nc\n</L>\n</R>\n'),
        ("L", "remove", "content", '<R a="1" b="2">\n<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\n</L>\n</R>\n'),
        ("R", "retain", "cdata", '<R a="1" b="2">\n<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\na, b,c.\n</L>\nraw <i>\n</R>\n'),
        ("R", "retain", "comment", '<R a="1" b="2">\n<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\na, b,c.\n</L>\nnote\n</R>\n'),
        ("R", "remove", "attributes", "<R>\n<N>\nx  y &lt;b&gt;\n</N>\n<N/>\n<L>\na, b,c.\n</L>\n</R>\n"),
    ],
)
def test_edits(name, action, target, want):
    assert W.edited(XML, name, action, target) == want


def test_no_such_edit(spark):
    with pytest.raises(ValueError):
        W.filtered(spark.createDataFrame([(1, XML)], "rec_id long, xml string"), "N", "explode", "object")


def test_streamed_records(spark, tmp_path):
    """A file that is split gives the same records as one read whole."""
    body = "\n".join(f'<Rec id="{i}"><v>{"x" * (i % 50)}</v></Rec>' for i in range(3000))
    (tmp_path / "a.xml").write_text(f"<?xml version='1.0'?><Set>{body}</Set>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = K.stream_records(spark, str(tmp_path), "Rec")
        assert got.rdd.getNumPartitions() > 3
        assert sorted(r["xml"] for r in got.collect()) == sorted(r["xml"] for r in K.read_records(spark, str(tmp_path), "Rec").collect())
        assert got.select("rec_id").distinct().count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_translation_options():
    cds = "TTGGCCTAAGCN"
    assert N.translate_cds(cds) == "MA"
    assert N.translate_cds(cds, keep_stop=True) == "MA*"
    assert N.translate_cds(cds, every=True) == "MA*A"
    assert N.translate_cds(cds, part5=True) == "LA"
    assert N.translate_cds(cds, every=True, between="-") == "M-A-*-A"
    assert N.translate_cds("ATGNNNTAA", every=True, trim=True) == "M"
    assert N.translate_cds("ATGTA", keep_stop=True) == "M" and N.translate_cds("ATGGC", keep_stop=True) == "MA"
    assert len(N.genetic_code(1)) == 64 and ("ATG", "M", True) in N.genetic_code(2)
    assert N.codon_report("ATGGC", "MA") == "ATG GCN " + "    " * 13 + "     2\n M   A  \n\n"
    assert N.codon_report("ATGGC", "MA", three=True).split("\n")[1] == "Met Ala "
    assert N.codon_report("AT", "M") == ""


@pytest.mark.parametrize(
    "text, want",
    [
        ("NM_1.2:c.5_6delAC", ("Deletion", 4, "AC", "")),
        ("NM_1.2:c.5del", None),
        ("NM_1.2:c.5_6delACinsTTT", ("Indel", 4, "AC", "TTT")),
        ("NC_1:g.5_6insG", ("Insertion", 5, "", "G")),
        ("NC_1:g.5_6dupAC", ("Duplication", 6, "", "AC")),
        ("NC_1:g.5_9insG", None),
        ("NC_1:g.5_6delA", None),
        ("NC_1:g.5A>G", ("Substitution", 4, "A", "G")),
    ],
)
def test_variant_kinds(text, want):
    got = G.parse(text)
    assert (got and (got["type"], got["position"], got["deleted"], got["inserted"])) == want


def test_search_helpers(spark):
    assert Q.rewrites("cat dog* AND (x1 ~~ bird) [TITL]".replace(" [TITL]", ""), frozenset()) == [("tokens", "cat | dog* | AND | ( | x1 | ~~ | bird | )"), ("tree", "(<cat dog*> AND (<x1> ~~ <bird>))")]
    with pytest.raises(ValueError):
        Q.exact_title(spark.createDataFrame([], "uid long, term string, pos int"), "of the")
    assert Q.ranked_pairs(spark.createDataFrame([(1, "a", 0)], "uid long, term string, pos int"), "the of").count() == 0
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "uid long")
    got = Q.named_results({"a": one(1, 2, 3), "b": one(2, 3, 4), "c": one(3)}, "#a AND #b NOT #c OR #c")
    assert sorted(r["uid"] for r in got.collect()) == [2, 3]


def test_aligned_modes(spark):
    df = spark.createDataFrame([("a", "1234567", "1.5"), ("long", "12", "10"), (None, "x", "y")], "t string, n string, d string")
    lines = lambda modes: [r["line"] for r in B.align_columns(df, modes).collect()]
    assert lines("lNm") == ["a     1,234,567   1.5", "long         12  10", "      x          y"]
    assert lines("crz") == [" a    1234567  1.5", "long       12  010", "            x  y"]
    assert [r["line"] for r in B.align_columns(df.select("n"), "l", least=9).collect()] == ["1234567", "12", "x"]


def test_text_helpers(spark):
    row = spark.range(1).select(T.pairs_and_singles(F.lit("Cat, the red dog of war. bird")).alias("p"), W.without_inline_markup(F.lit("a <i>b</i> &lt;sup&gt;2&lt;/sup&gt; <x>")).alias("w"), W.pretty_json(F.lit('{"a":[1]}')).alias("j"), W.pretty_json(F.lit("{")).alias("bad")).first()
    assert sorted(row["p"]) == ["bird", "cat", "red dog", "war"]
    assert row["w"] == "a b 2 <x>" and row["j"] == '{\n  "a": [\n    1\n  ]\n}' and row["bad"] is None


def test_normalised_citations(spark):
    c = spark.createDataFrame([(1, " Ray  A", "A  title. ", "J. Biol. Chem.", "1999 Jan", "3", "12-19"), (2, None, None, None, None, None, None)], "id long, author string, title string, journal string, year string, volume string, page string")
    got = {r["id"]: r for r in M.normalised(c).collect()}
    assert got[1]["text"] == "Ray A. A title. J Biol Chem. 1999. 3. 12" and got[2]["text"] == ""
