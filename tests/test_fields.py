"""Variants, external tables, and string and sequence search."""

from pyspark.sql import functions as F

from lamina.operators import fields as X
from lamina.operators import variants as G


def test_variants(spark):
    df = spark.createDataFrame([("rs1", "NC_1.11:g.100A>G,NM_5.2:c.3T>C,NM_5.3:c.3T>C,XM_9.1:c.4A>C,NP_7.1:p.Ala12Val,NP_7.1:p.Ala12=,NM_5.3:c.3del"), ("rs2", None)], "id string, text string")
    v = G.variants(df)
    assert v.count() == 6
    kept = G.newest(v)
    got = sorted((r["accession"], r["version"], r["class"], r["position"], r["inserted"]) for r in kept.collect())
    assert got == [("NC_1", 11, "Genomic", 99, "G"), ("NM_5", 3, "Coding", 2, "C"), ("NP_7", 1, "Protein", 11, "A"), ("NP_7", 1, "Protein", 11, "V")]
    names = {r["spdi"] for r in G.spdi(kept).collect()}
    assert "NC_1.11:99:A:G" in names and "NP_7.1:11:A:V" in names
    moved = G.with_offset(kept, spark.createDataFrame([("NM_5", 10)], "accession string, offset long"))
    assert {r["position"] for r in moved.where("accession = 'NM_5'").collect()} == {12}
    made = G.products(kept, spark.createDataFrame([("NM_5", "AATGG"), ("NC_1", "A")], "accession string, sequence string"))
    assert [(r["accession"], r["sequence"]) for r in made.collect()] == [("NM_5", "AACGG")]
    x = spark.createDataFrame([("a:1:C:",), ("bad",)], "s string").select(G.parse_spdi(F.col("s")).alias("p")).collect()
    assert x[0]["p"]["inserted"] == "" and x[1]["p"] is None


def test_external_tables(spark):
    rows = spark.createDataFrame([(1, "gene", "G1"), (1, "gene", "G2"), (1, "gene", "G1"), (2, "chem", "C9")], "uid long, kind string, code string")
    table = spark.createDataFrame([("G1", "alpha")], "code string, term string")
    assert sorted((r["uid"], r["field"], tuple(r["terms"])) for r in X.concepts(rows, table).collect()) == [(1, "GENE", ("G2", "alpha")), (2, "CHEM", ("C9",))]
    scores = spark.createDataFrame([(1, 50, 30, 20), (2, 0, 0, 0)], "uid long, a long, b long, c long")
    assert [tuple(r) for r in X.themes(scores, ["a", "b", "c"]).collect()] == [(1, "a", 50)]
    edges = X.link_edges(spark.createDataFrame([(1, 2), (1, 2), (3, None)], "citing long, referenced long"))
    assert sorted(map(tuple, edges.collect())) == [(1, 2, "CITES"), (2, 1, "CITED")]
    nodes = spark.createDataFrame([(1, 1, "root", 0), (2, 1, "kingdom", 0), (3, 2, "genus", 0), (4, 3, "species", 0), (5, 4, "strain", 0)], "tax_id long, parent long, rank string, division_id int")
    names = spark.createDataFrame([(i, f"n{i}", "scientific name") for i in range(1, 6)] + [(4, "common", "common name")], "tax_id long, name string, class string")
    got = {r["tax_id"]: (r["name"], r["division"], r["lineage"]) for r in X.taxonomy(nodes, names, spark.createDataFrame([(0, "All")], "division_id int, division string")).collect()}
    assert got[5] == ("n5", "All", "n1; n2; n3; n4") and got[1] == ("n1", "All", "")
    tree = X.tree_ancestors(spark.createDataFrame([("C01.252.410",)], "code string"))
    assert sorted(r["ancestor"] for r in tree.collect()) == ["C01", "C01.252", "C01.252.410"]


def test_records(spark):
    recs = spark.createDataFrame([("A", "<R><x/></R>\n"), ("b", "<R></R>")], "id string, xml string")
    got = X.append_fragments(recs, spark.createDataFrame([("a", "<y>1</y>")], "id string, fragment string"))
    assert [tuple(r) for r in got.collect()] == [("A", "<R><x/><y>1</y></R>")]
    assert spark.range(1).select(X.damaged(F.lit("&amp;lt; &amp;amp;gt; &lt; &amp; x"))).first()[0] == 2


def test_find(spark):
    df = spark.createDataFrame([(1, "ABabcab"), (2, None)], "id long, text string")
    assert sorted(map(tuple, X.find(df, ["ab", "abc"]).collect())) == [(1, 0, "ab"), (1, 2, "ab"), (1, 2, "abc"), (1, 5, "ab")]
    assert sorted(r["position"] for r in X.find(df, ["BAB"], sensitive=True, circular=True).collect()) == []
    assert sorted(r["position"] for r in X.find(df, ["bAB"], sensitive=True, circular=True).collect()) == [6]
    seq = spark.createDataFrame([(1, "GGATCCTTGA")], "id long, text string")
    got = sorted((r["position"], r["alias"]) for r in X.find_sequences(seq, {"GGATCC": "BamHI", "TCAR": "x"}).collect())
    assert got == [(0, "BamHI"), (6, "x-")]
    assert X.find_sequences(seq, {"TCAR": "x"}, top_only=True).count() == 0
