from lamina.sources.asn import asn_records, to_xml

TEXT = """Made-up ::= {
  name "a ""b"" <c
 d" , -- a note
  id local 5 ,
  bits '0A 1F'H ,
  list { { x 1 } , { x 2 } } ,
  plain { 7 , 8 }
}
Second ::= { a TRUE"""


def test_asn(spark):
    want = ['<Made-up><name>a "b" &lt;cd</name><id><local>5</local></id><bits>0A1F</bits><list><list_E><x>1</x></list_E><list_E><x>2</x></list_E></list><plain><plain_E>7</plain_E><plain_E>8</plain_E></plain></Made-up>', "<Second><a>TRUE</a></Second>"]
    assert to_xml(TEXT) == want
    assert [r["xml"] for r in asn_records(spark.createDataFrame([(TEXT,), (None,), ("} {",)], "value string")).collect()] == want
