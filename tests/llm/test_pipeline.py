import sentencepiece

import corpus_pipeline
from tideglass.llm import langid
from tideglass.llm.queries import piece_model

from . import brute


def test_pipeline_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    pred = {r.doc_id: r for r in langid.predict(table, langid.fit(table)).collect()}
    texts = {d: rows[d].text for d in rows if pred[d].lang_pred != "und" and pred[d].score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert len(texts) > 0.97 * len(rows)
    space, lower = " \t\n\r\x0b\x0c", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = {}
    for d, x in texts.items():
        for line in x.split("\n"):
            if len(k := line.strip(space).translate(lower)) >= 20:
                held.setdefault(k, set()).add(d)
    drop = {k: max(ds) for k, ds in held.items() if len(ds) >= 3}
    texts = {d: "\n".join(y for y in x.split("\n") if drop.get(y.strip(space).translate(lower), d) == d) for d, x in texts.items()}
    near = brute.near_dups(texts.items())
    texts = {d: x for d, x in texts.items() if near[d][2]}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hits = brute.decontaminate(texts.items(), items)
    texts = {d: x for d, x in texts.items() if not hits[d][-1]}
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = {d: (len(ids), ids, brute.sha(sp.decode(ids))) for d, x in texts.items() for ids in [sp.encode(x)]}
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


def test_stages_keep_columns(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(50)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "12 !! 34", None, "s", 8)], docs.schema)
    docs = docs.union(odd).union(odd)
    for name in ("doc", "tag", "keep", "kept", "score", "lang_pred", "starts", "items", "n_words", "node", "hits", "id", "h"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit(name))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small_dir)
        assert out.columns == docs.columns
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.where("false"), small_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).count() == docs.count()
