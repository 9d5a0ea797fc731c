"""Column functions and operators on small, hard values."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import sequence as N
from lamina.functions import text as T
from lamina.functions import values as V
from lamina.operators import index as I
from lamina.operators import match as M
from lamina.operators import scope as S
from lamina.operators import search as Q
from lamina.operators import tables as B
from lamina.operators.positions import positions
from lamina.sources import converters as C
from lamina.sources import markup as K


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


def arr(*v):
    return F.array(*(F.lit(x) for x in v)).cast("array<string>")


NUMERIC = [
    (V.total, ("5", " 5", "+5", "007", "5.7", "", "x"), 17), (V.total, ("x",), None), (V.avg, ("-1", "-2"), -1), (V.dev, ("4",), None), (V.dev, ("2", "4", "4", "4", "5", "5", "7", "9"), 2),
    (V.med, ("1", "2", "3", "4"), 3), (V.sub, ("5", "3"), 2), (V.sub, ("5",), None), (V.sub, ("5", "3", "1"), None), (V.mul, ("-5", "3"), -15), (V.div, ("-7", "2"), -3), (V.div, ("7", "0"), None),
    (V.mod, ("-7", "2"), -1), (V.binary, ("-5",), ["-101"]), (V.octal, ("-9",), ["-11"]), (V.hexadecimal, ("-255",), ["-FF"]), (V.bits, ("-1",), [64]), (V.running, ("1", "x", "2", "3"), [1, 3, 6]),
    (V.length, ("é", "ab"), 4), (V.least, ("3", "-2"), -2), (V.greatest, ("3", "-2"), 3), (V.inc, ("1", "x"), [2]), (V.num, ("a", ""), 2), (V.pad, ("12", "123456789", "a"), ["00000012", "123456789", "a"]),
]
TEXTUAL = [
    (V.first, ("", "b", "c"), "b"), (V.last, ("a", "b"), "b"), (V.first, (), None), (V.backward, ("a", "b"), ["b", "a"]), (V.encode, ("<a&'\">",), ["&lt;a&amp;&#39;&#34;&gt;"]), (V.decode, ("aGk=", "%%"), ["hi"]),
    (V.title, ("the quick-brown FOX's den",), ["The Quick-Brown Fox's Den"]), (V.alnum, ("--a, b!", "!!"), ["a b"]), (V.order, ("Zeta, alpha", "One."), ["alpha zeta", "one"]), (V.year, ("no", "in 19 and 1999x2001"), "1999"),
    (V.month, ("x", "12 September 2020"), 9), (V.page, ("1904-14",), ["1904"]), (V.auth, ("Smith-Jones,J.-P.",), ["Smith-Jones JP"]), (V.initials, ("John Paul", "JP", "j-p"), ["JP", "JP", "JP"]), (V.trim, (" 007 ", "0"), ["07", "0"]),
    (V.doi, ("doi:10.1/a b*~",), ["https://doi.org/10.1%2Fa+b%2A~"]), (V.accented, ("a", "é"), ["é"]), (V.mirror, ("abc",), ["cba"]), (V.chain, ("a b",), ["a_b"]),
]


@pytest.mark.parametrize(("f", "v", "want"), NUMERIC + TEXTUAL, ids=lambda x: getattr(x, "__name__", None))
def test_values(value, f, v, want):
    assert value(f(arr(*v))) == want


def test_conditions(value):
    assert value(V.is_not(arr("a", "b"), "A")) and not value(V.is_not(arr("a"), "A")) and not value(V.is_not(arr(), "A"))
    assert value(V.includes(arr("the cat sat"), "cat")) and not value(V.includes(arr("the cats"), "cat"))
    assert value(V.is_within(arr("bc"), "abcd")) and value(V.matches(arr("A, b."), "a b")) and value(V.resembles(arr("beta alpha"), "Alpha Beta"))
    assert value(V.compare(arr("x", "5"), "ge", F.lit(5))) and not value(V.compare(arr("5.5"), "ge", F.lit(5)))
    true, false = F.lit(True), F.lit(False)
    assert not value(V.threshold(true, [false], [false])) and value(V.threshold(false, [true], [true])) and value(V.threshold(true, [], []))
    assert not value(V.unless(false, true)) and value(V.unless(false, F.lit(None).cast("boolean")))


def test_ranges(value):
    x = F.lit("abcdef")
    assert value(V.slice_range(x, F.lit(2), F.lit(4))) == "bcd" and value(V.slice_range(x, F.lit(2), F.lit(9))) is None
    assert value(V.slice_range(x, F.lit(2), F.lit(-1))) == "bcde"
    assert value(V.between(F.lit("One TWO three"), "one ", " THREE")) == "TWO" and value(V.between(x, "q")) is None


def test_text(value):
    assert value(T.pairs(F.lit("alpha beta of gamma delta, epsilon zeta"))) == ["alpha beta", "gamma delta", "epsilon zeta"]
    assert value(T.terms(F.lit("a. b,; . c:d"))) == ["a", "b", ".", "c:d"] and value(T.clauses(F.lit("A b. c;;D"))) == ["a b", "c", "d"]
    assert value(T.fold(F.lit("Ærøé ß"))) == "AEroe ss" and value(T.simple(F.lit("α²"))) == "alpha2" and value(T.plain(F.lit("<i>é</i> x"))) == "e x"
    assert value(T.decode_url(T.encode_url(F.lit("a b*~é")))) == "a b*~é" and value(T.decode64(T.encode64(F.lit("x" * 100)))) == "x" * 100


STEMS = {"consign": "consign", "consigned": "consign", "consistency": "consist", "knackeries": "knackeri", "knaves": "knave", "kneeling": "kneel", "knots": "knot", "generously": "generous", "skies": "sky", "hopping": "hop", "hoped": "hope", "relational": "relat", "happily": "happili", "conditional": "condit", "national": "nation", "cry": "cri", "by": "by", "say": "say", "agreed": "agre", "luxuriate": "luxuri", "ties": "tie", "gas": "gas", "this": "this"}


@pytest.mark.parametrize(("word", "want"), STEMS.items())
def test_stem(word, want):
    assert T.stem(word) == want


def test_sequences(value):
    s = F.lit("ATGGCCATTRtaa")
    assert value(N.revcomp(F.lit("ACGTRzn"))) == "nXYACGT" and value(N.extract(s, F.lit("1..3,6..4,2..2"))) == "ATGGGC"
    assert value(N.fasta(F.lit("a" * 141))) == ["A" * 70, "A" * 70, "A"] and value(N.unpack(F.lit("1B"), 2)) == "ACGT" and value(N.unpack(F.lit("1248"), 4)) == "ACGT"
    assert N.translate_cds("ATGGCCATTTAA") == "MAI" and N.translate_cds("TTGGCNRAYTA") == "MAB" and N.translate_cds("GCNATGGC") == "AMA" and N.translate_cds("TGA", 2) == "W"
    assert value(N.cds_to_protein(F.lit("ATGGCN"))) == "MA" and value(N.plain_translation(F.lit("ATGGCCTAA"))) == "MA*"
    assert value(N.edit(F.lit("ACGT"), F.lit(1), F.lit("cg"), F.lit("T"))) == "ATT" and value(N.edit(F.lit("ACGT"), F.lit(4), F.lit(""), F.lit("A"))) == "ACGTA" and value(N.edit(F.lit("ACGT"), F.lit(1), F.lit("T"), F.lit(""))) is None
    assert value(N.disambiguate(F.lit("AR"))) == ["AA", "AG"] and value(N.remove_ends(F.lit("ACG"), 2, 2)) == "" and value(N.retain(F.lit("ACGT"), trailing=2)) == "GT"
    assert value(N.three_letters(F.lit("MA"))) == "MetAla" and value(N.one_letter(F.lit("MetAlaTer"))) == "MA*"
    assert value(N.molecular_weight(F.lit("MG"))) == 75 and value(N.differences(F.lit("ACG"), F.lit("ATGA"))) == "aTgA"


RECORD = "<Set><R id='1'><A>x<A>y</A></A><B/><P><A>z &amp; w</A></P><A t=\"k\">last</A></R><R id='2'><!-- <A>no</A> --><A><![CDATA[<c>]]></A></R></Set>"


def test_markup(spark):
    texts = spark.createDataFrame([(RECORD,)], "value string")
    recs = K.records(texts, "R")
    assert [r["xml"][:9] for r in recs.orderBy("rec_id").collect()] == ["<R id='1'", "<R id='2'"] and K.records(texts, "Set/*").count() == 2
    nodes = K.node_table(recs)
    top = S.whole(nodes)
    get = lambda scope, sel: [r["values"] for r in S.values(nodes, scope, sel).orderBy("rec_id", "ord").collect()]
    assert get(top, "A") == [["x", "y", "z & w", "last"], ["<c>"]]
    assert get(top, "P/A") == [["z & w"], []] and get(top, "A@t") == [["k"], []] and get(top, "#A") == [["4"], ["1"]] and get(top, "%B") == [["0"], ["0"]]
    assert get(top, "A[1:2]") == [["z ", "la"], ["<c"]] and get(top, "R@id") == [["1"], ["2"]]
    count = lambda path: S.visit(nodes, top, path).count()
    assert count("A") == 4 and count("**/A") == 5 and count("A/**") == 1 and count("R/*") == 5 and count("R.P.A") == 1
    assert [r["name"] for r in S.visit(nodes, top, "R/*").join(nodes.select("rec_id", "pre", "name"), ["rec_id", "pre"]).orderBy("rec_id", "pre").collect()] == ["A", "B", "P", "A", "A"]
    first = S.position(S.visit(nodes, top, "A"), "last", ["rec_id"])
    assert get(first, "A") == [["last"], ["<c>"]]
    assert {r["path"] for r in S.synopsis(nodes).collect()} == {"R", "R/A", "R/A/A", "R/B", "R/P", "R/P/A"}


@pytest.mark.parametrize("text", ["", "<", "<a", "<a><b></a></b>", "</x>", "<a b=c d='e' f>", "a<b>c", "<!-- x", "<![CDATA[", "<p>1<br>2<p>3"])
def test_malformed_never_raises(text):
    for n in K.nodes_of(text):
        assert n["pre"] <= n["end"]
    K.problems(text)


def test_search(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta alpha x gamma"), (3, "gamma y y beta"), (4, "alphabet soup"), (5, None)], "doc_id long, text string")
    index = positions(docs)
    get = lambda q: sorted(r["uid"] for r in Q.search(index, q, frozenset()).collect())
    assert get("alpha beta") == [1] and get("alpha + gamma") == [1, 2] and get("alpha*") == [1, 2, 4] and get("alpha AND beta NOT delta") == [2]
    assert get("soup OR alpha AND delta") == [1, 4] and get("(soup OR alpha) AND delta") == [1] and get("gamma ~ beta") == [] and get("gamma ~~ beta") == [3]
    assert get("alpha ~ gamma ~ delta") == [1]
    with pytest.raises(ValueError):
        Q.search(index, "(a OR b) ~ c", frozenset())
    with pytest.raises(ValueError):
        Q.search(index, "the of")


def test_paragraph_gap(spark):
    docs = spark.createDataFrame([(1, ["Alpha of Beta-2 12", "Gamma."])], "uid long, p array<string>")
    rows = {(r["term"], r["pos"]) for r in I.paragraph_terms(docs, "uid", F.col("p"), "T").collect()}
    assert rows == {("alpha", 0), ("beta", 2), ("gamma", 100)}


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha word{i} beta word{i % 3}") for i in range(20)], "doc_id long, text string")
    index = positions(docs).withColumn("field", F.lit("TEXT"))
    I.write_index(I.invert(index), str(tmp_path / "x"))
    back = I.read_index(spark, str(tmp_path / "x"))
    assert sorted(r["uid"] for r in Q.search(back, "word7 beta [TEXT]").collect()) == [7]
    both = I.merge(I.invert(index), I.invert(index))
    assert both.count() == I.invert(index).count()


def test_incremental_equals_batch(spark, tmp_path):
    from lamina.streaming import incremental

    docs = spark.createDataFrame([(i, f"alpha word{i} beta") for i in range(10)], "doc_id long, text string")
    source, target, check = (str(tmp_path / x) for x in "stc")
    for half in (docs.where("doc_id < 5"), docs.where("doc_id >= 5")):
        half.write.mode("append").parquet(source)
        incremental.follow(spark, source, "doc_id long, text string", target, check)
    rows = lambda df: sorted(map(tuple, df.select("field", "term", "uid", "positions").collect()))
    assert rows(incremental.current(spark, target)) == rows(incremental.index_batch(docs))


def test_tables(spark):
    rows = spark.createDataFrame([("+", 1, 5), ("+", 6, 8), ("+", 20, 15), ("+", 2, 3), ("-", 10, 12), ("-", 14, 15)], "s string, start int, end int")
    assert sorted(map(tuple, B.fuse_ranges(rows, ["s"]).collect())) == [("+", 1, 8, 8), ("+", 15, 20, 6), ("-", 10, 12, 3), ("-", 14, 15, 2)]
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "uid int")
    a, b = ids(1, 2, 2, 3), ids(2, 3, 3, 4)
    get = lambda df: sorted(r["uid"] for r in df.collect())
    assert get(B.union_ids(a, b)) == [1, 2, 3, 4] and get(B.intersect_ids(a, b)) == [2, 3] and get(B.exclude_ids(a, b)) == [1, 2] and get(B.difference_ids(a, b)) == [1, 2, 3, 4]
    seq = spark.createDataFrame([(i, c) for i, c in enumerate("xAyzBwA")], "i int, c string")
    assert "".join(r["c"] for r in B.between_markers(seq, "i", F.col("c") == "A", F.col("c") == "B").orderBy("i").collect()) == "AyzB"
    wide = B.align(spark.createDataFrame([("a", 5), ("bcd", 50)], "x string, y int"), ["y"])
    assert sorted(r["line"] for r in wide.collect()) == ["a     5", "bcd  50"] or sorted(r["line"] for r in wide.collect()) == ["a     5", "bcd  50"]
    events = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "uid int, o int")
    assert sorted(map(tuple, B.keep_from_nth(events, spark.createDataFrame([(1,), (1,)], "uid int"), "uid", "o").collect())) == [(1, 2), (1, 3)]


def test_matching(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon eta"), (3, "other words entirely")], "id long, text string")
    cits = spark.createDataFrame([(10, "Alpha beta gamma delta epsilon zeta"), (11, "nothing here")], "id long, text string")
    assert [tuple(r) for r in M.match(cits, docs).collect()] == [(10, 1, 100)]
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int")
    assert sorted(map(tuple, M.keep_unless_empty(rows, "k", F.col("v") == 5).collect())) == [(1, 5), (2, 7)]


def test_converters(spark, tmp_path):
    texts = spark.createDataFrame([('{"a b": [1.50, "x<y"], "c": {"d": null, "e": ""}} {"f": true} {',)], "value string")
    assert [r["xml"] for r in C.json_records(texts).collect()] == ["<Rec><a_b>1.50</a_b><a_b>x&lt;y</a_b><c><d>null</d><e/></c></Rec>", "<Rec><f>true</f></Rec>"]
    path = tmp_path / "t.tsv"
    path.write_text("k\tv\na\t1\na\t2\nb\nc\t<3\n")
    assert sorted(map(tuple, C.transform_table(spark, str(path)).collect())) == [("a", "2"), ("c", "<3"), ("k", "v")]
    table = C.read_table(spark, str(path), ["k", "v"], skip=1)
    assert sorted(r["xml"] for r in C.to_records(table).collect())[-1] == "<Rec><k>c</k><v>&lt;3</v></Rec>"
    assert C.wrapped(C.to_records(table).limit(0), "<S>", "</S>").count() == 0 and C.wrapped(C.to_records(table), "<S>", "</S>").count() == 5
    (tmp_path / "s.fa").write_text(">id1 the title\nACG\nT\n>id2\nGG\n")
    assert [tuple(r) for r in C.read_fasta(spark, str(tmp_path / "s.fa")).collect()] == [("id1", "the title", 4, "ACGT"), ("id2", "", 2, "GG")]
    assert C.parse_location("complement(join(1..5,<7..>9))") == [(9, 7), (5, 1)] and C.parse_location("join(X1.1:1..2,complement(4..6),8)") == [(6, 4), (8, 8)]


FLATFILE = """LOCUS       AB1   12 bp  DNA
DEFINITION  A made-up record
            on two lines.
ACCESSION   AB1
VERSION     AB1.2
  ORGANISM  Testus exemplaris
FEATURES             Location/Qualifiers
     gene            1..6
                     /gene="abc"
     CDS             complement(join(1..3,
                     5..6))
                     /gene="abc"
                     /translation="MA
                     G"
ORIGIN
        1 acgtacgtac gt
//
"""


def test_flatfile(spark, tmp_path):
    (tmp_path / "x.gb").write_text(FLATFILE + FLATFILE.replace("AB1", "AB9"))
    flat = C.read_flatfile(spark, str(tmp_path / "x.gb"))
    rows = flat.orderBy("accession").collect()
    assert [(r["accession"], r["version"], r["definition"], r["organism"], r["sequence"]) for r in rows] == [(a, "2", "A made-up record on two lines", "Testus exemplaris", "acgtacgtacgt") for a in ("AB1", "AB9")]
    cds = [tuple(r) for r in C.feature_table(flat, "CDS", ["gene", "translation", "note"]).orderBy("accession").collect()][0]
    assert cds == ("AB1", 1, "complement(join(1..3,5..6))", "abc", "MAG", "-")
