"""Extraction programs on small records, against output written by hand."""

import pytest

from lamina.operators import program as P
from lamina.operators import scope as S
from lamina.sources import markup as K

BOOK = '<Book id="7" lang="en"><Title>On &lt;Tags&gt; &amp; such</Title><Authors><Author><Last>Ray</Last><Init>A B</Init></Author><Author><Last>Diaz</Last></Author><Author/></Authors><Page>10</Page><Page>12</Page><Note><Note>deep</Note></Note><Empty/></Book>'


def out(*arguments, text=BOOK):
    return P.Run(text, frozenset()).printed(P.parse(["-pattern", "Book", *arguments]), 1)


@pytest.mark.parametrize(
    "arguments, want",
    [
        (["-element", "Last"], "Ray\tDiaz\n"),
        (["-element", "Book@id", "Page"], "7\t10\t12\n"),
        (["-sep", "+", "-element", "Last,Page", "Absent", "#Author"], "Ray+Diaz+10+12\t3\n"),
        (["-def", "none", "-element", "Absent", "-pfx", "<", "-sfx", ">", "-element", "Absent"], "none\t<none>\n"),
        (["-tab", "|", "-element", "Book@id", "-clr", "-lbl", "x", "-deq", "=", "-lbl", "y"], "7x=y\n"),
        (["-pfc", "!", "-element", "Page"], "!10\t12\n"),
        (["-plg", "(", "-elg", ")", "-sep", ",", "-element", "Page", "Book@id"], "(10,12\t7)\n"),
        (["-block", "Author", "-element", "Last"], "Ray\tDiaz\n"),
        (["-block", "Author", "-tab", "\\n", "-element", "+", "-deq", ":", "-element", "Last"], "1:Ray\n2:Diaz\n3\n"),
        (["-block", "Author", "-if", "Init", "-element", "Last", "-else", "-lbl", "-"], "Ray\t-\t-\n"),
        (["-block", "Author", "-position", "last", "-lbl", "last"], "last\n"),
        (["-block", "Author", "-position", "2", "-element", "Last"], "Diaz\n"),
        # the record itself is searched too
        (["-path", "Book.Authors.Author", "-element", "Last"], "Ray\tDiaz\n"),
        (["-path", "Authors.Author.Last", "-element", "~"], "Ray\tDiaz\n"),
        (["-group", "Authors", "-pkg", "List/Of", "-block", "Author", "-clr", "-wrp", "N", "-tab", "", "-element", "Last"], "<List><Of><N>Ray</N><N>Diaz</N></Of></List>\n"),
        (["-wrp", "Title", "-element", "Title"], "<Title>On &lt;Tags&gt; &amp; such</Title>\n"),
        (["-element", "Title", "-raw", "Title"], "On <Tags> & such\tOn &lt;Tags&gt; &amp; such\n"),
        (["-V", "Last", "-COM", "(, )", "-element", "&V,&COM"], "Ray\tDiaz\t, \n"),
        (["-V", "Last", "-V", "", "-if", "&V", "-element", "&V"], ""),
        (["-sep", ",", "--V", "Last", "--V", "Page", "-element", "&V"], "Ray,Diaz,10,12\n"),
        (["-block", "Author", "-T", "(Who)", "-wrp", "&T", "-element", "Last"], "<Who>Ray</Who>\t<Who>Diaz</Who>\n"),
        (["-sum", "Page", "-num", "Page", "Author", "-max", "Page", "-inc", "Page"], "22\t2\t3\t12\t11\t13\n"),
        (["-reg", "([a-z]+)", "-exp", "<$1>", "-replace", "Last"], "R<ay>\tD<iaz>\n"),
        (["-element", "Title[1:2]", "Title[-3:]", "Title[5:8]", "Title[8:-5]", "Title[12:99]", "Title[tags|such]"], "On\tTags\ts> &\t> & \n"),
        (["-element", "?", "-sep", ",", "-element", "$", "@"], "Book\tTitle,Authors,Page,Page,Note,Empty\tid,lang\n"),
        (["-if", "Page", "-equals", "10", "-and", "Last", "-starts-with", "d", "-or", "Absent", "-lbl", "two of three"], "two of three\n"),
        (["-unless", "Absent", "-or", "Page", "-lbl", "no"], ""),
        (["-if", "Page", "-gt", "11", "-lbl", "yes"], "yes\n"),
        (["-if", "#Author", "-eq", "#Last", "-lbl", "yes", "-else", "-lbl", "no"], "no\n"),
        (["-match", "Last:ray", "-lbl", "hit"], "hit\n"),
        (["-avoid", "Last:ray", "-lbl", "hit"], ""),
        (["-block", "**/Note", "-element", "^Note", "-deq", "/", "-element", "~"], "2\t2/3/deep\n"),
        (["-block", "Authors", "-element", "*"], "<Authors><Author><Last>Ray</Last><Init>A B</Init></Author><Author><Last>Diaz</Last></Author></Authors>\n"),
        (["-block", "Author", "-position", "first", "-element", "**"], "<Author>\n<Last>Ray</Last>\n<Init>A B</Init>\n</Author>\n\n"),
        (["-block", "Author", "-position", "first", "-element", "****"], "<Author>\n  <Last>Ray</Last>\n  <Init>A B</Init>\n</Author>\n\n"),
    ],
)
def test_output(arguments, want):
    assert out(*arguments) == want


def test_bad_programs():
    for arguments in (["-element", "x"], ["-pattern"], ["-pattern", "A", "-nonsense", "x"], ["-pattern", "A", "-pattern", "B"]):
        with pytest.raises(ValueError):
            P.parse(arguments)


def test_both_parsers_agree(spark):
    """Plain records through expat give what the tolerant tokenizer gives; broken ones are read too."""
    texts = [BOOK, "<a>x<b>1</b> y <b c='&quot;q&quot;'/></a>", "<a>&#233;t&#xe9;</a>", "<a> two   words\n<b/>more </a>", "<a>"]
    for t in texts:
        slow = K.nodes_of(t, frozenset())
        fast = K.tree_of(t)
        for k, own in (("name", fast.names), ("parent", fast.parents), ("end", fast.ends), ("depth", fast.depths), ("contents", fast.contents), ("attrs", fast.attrs)):
            assert [n[k] for n in slow] == own, (t, k)
    odd = ["<a><b>1</a>", "<a>&nbsp;x</a>", "<a><!-- c --><b/></a>", "<a xmlns:x='u'><x:b/></a>", "no markup", "<a/><a/>"]
    assert [K.tree_of(t).names for t in odd] == [["a", "b"], ["a"], ["a", "b"], ["a", "x:b"], [], ["a", "a"]]


@pytest.mark.parametrize("path", ["", "*", "Author", "Authors/Author", "Authors/*", "Authors/**", "Authors.Author", "**/Note", "*/Note", "Note", ":thor"])
def test_extract_equals_the_joins(spark, path):
    """One pass over records gives what visits of the node table give, for every kind of path."""
    records = spark.createDataFrame([(1, BOOK), (2, BOOK.replace("Author", "x:Author")), (3, None), (4, "<Book><Author><Last>A</Last></Author>")], "rec_id long, xml string")
    nodes = K.node_table(records)
    scope = S.whole(nodes)
    scope = S.visit(nodes, scope, path) if path not in ("", "*") else scope
    chosen = {"last": "Last", "page": "Page,#Author", "attr": "@lang", "level": "^Last", "cut": "Last[1:2]", "bytes": "%Last"}
    want = S.columns(nodes, scope, **chosen)
    got = S.extract(records, path, **chosen)
    key = lambda df: sorted(map(repr, df.select(*want.columns).collect()))
    assert key(got) == key(want)


def test_paths_equal_the_joins(spark):
    records = spark.createDataFrame([(1, BOOK), (2, BOOK), (3, None)], "rec_id long, xml string")
    for leaves in (False, True):
        want = sorted(map(tuple, S.synopsis(K.node_table(records), leaves_only=leaves).collect()))
        assert sorted(map(tuple, S.paths(records, leaves_only=leaves).collect())) == want


def test_run_over_a_table(spark):
    records = spark.createDataFrame([(1, BOOK), (2, None), (3, "<Book/>"), (4, "")], "rec_id long, xml string")
    got = P.run(records, ["-pattern", "Book", "-element", "Last"], head="<", tail=">").collect()
    assert [tuple(r) for r in got] == [(1, "<Ray\tDiaz\n>")]
    assert sorted(r[0] for r in P.silent(records, ["-pattern", "Book", "-element", "Last"]).collect()) == [2, 3, 4]
    whole = P.document(P.run(records, ["-pattern", "Book", "-element", "Last"]), "<Set>", "</Set>").orderBy("part").collect()
    assert [r["out"] for r in whole] == ["<Set>", "Ray\tDiaz\n", "</Set>"]
    assert P.document(P.run(records.where("rec_id = 2"), ["-pattern", "Book", "-element", "Last"]), "<Set>", "</Set>").count() == 0
    assert P.run(records, ["-pattern", "Book", "-select", "Page"]).collect()[0]["out"] == BOOK + "\n"
