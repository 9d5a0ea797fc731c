"""The pipeline against brute-force stages, on the smallest tables."""

import brute
import pandas as pd
import sentencepiece

import corpus_pipeline as P
from lamina.llm import toxicity
from lamina.llm.common import table
from lamina.llm.queries import PIECES

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    before = docs.toPandas()
    names = docs.columns
    clean = P.toxic(spark, docs, DATA)
    assert clean.columns == names
    kept = clean.toPandas()
    scores = toxicity.score(docs, toxicity.learn(docs, table(spark, DATA, "labels"))).toPandas()
    assert sorted(kept.doc_id) == sorted(scores[scores.predicted == 0].doc_id)
    assert dict(zip(kept.doc_id, kept.text, strict=True)).items() <= dict(zip(before.doc_id, before.text, strict=True)).items()

    less = P.shared_lines(spark, spark.createDataFrame(kept, docs.schema), DATA)
    assert less.columns == names
    got = less.toPandas()
    want = {d: s for d, _, _, s in brute.lines(list(zip(kept.doc_id, kept.text, strict=True)))}
    assert {r.doc_id: brute.sha(r.text) for r in got.itertuples()} == want
    assert (got.n_chars == got.text.str.len()).all()

    one = P.near_copies(spark, spark.createDataFrame(got, docs.schema), DATA)
    assert one.columns == names
    single = one.toPandas()
    want = {c for *_, c in brute.simhash(list(zip(got.doc_id, got.text, strict=True)))}
    assert set(single.doc_id) == want and len(single) == len(want)

    mix = P.mixed(spark, spark.createDataFrame(single, docs.schema), DATA)
    assert mix.columns == names
    taken = mix.toPandas()
    size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in single.itertuples()}
    by = pd.DataFrame({"source": taken.source, "n": taken.doc_id.map(size)}).groupby("source").n.sum()
    most = max(size.values())
    total = sum(size.values())
    assert taken.doc_id.value_counts().max() <= 4 and abs(by.sum() - total) <= most * len(by)

    ids = P.tokens(spark, spark.createDataFrame(taken, docs.schema), DATA).toPandas()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((r.doc_id, brute.sha(",".join(map(str, library.encode(r.text))))) for r in taken.itertuples())
    assert sorted(zip(ids.doc_id, ids.ids_sha256, strict=True)) == want


def test_run(spark):
    got = P.run(spark, DATA)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() > 0
