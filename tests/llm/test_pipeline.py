"""The stages one by one, each against a plain version over the rows that its predecessor kept."""

import public_tokenizers as P
import tiktoken
from test_llm_queries import brute_components

import corpus_pipeline
from lexspan.llm import byte_bpe, mixing, toxicity


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs)
    assert all(d.columns == columns for d in out[:-1])
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean, single, mixed, encoded = (d.toPandas() for d in out)
    scores = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels).scored(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).toPandas()
    assert set(clean.doc_id) == set(scores[scores.score < toxicity.THRESHOLD].doc_id)
    groups = brute_components(dict(zip(clean.doc_id, clean.text, strict=True)))
    assert sorted(single.doc_id) == sorted({c for _, c in groups.values()})
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(out[1]).collect()}
    counts = mixed.doc_id.value_counts().to_dict()
    assert counts == {d: t // s for d, (t, s) in taken.items() if t}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    texts = dict(zip(mixed.doc_id, mixed.text, strict=True))
    assert len(encoded) == len(mixed) and encoded.round_trip.all()
    assert all(list(i) == t.encode_ordinary(texts[d]) for d, i in zip(encoded.doc_id, encoded.ids, strict=True))


def test_whole(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, a very long text and columns of any name go through every stage; an empty table does, too."""
    sf = "/root/testdata/sf0.001"
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base, base + " end", None, "", "alone here", "alone here", "word " * 60_000 + "x" * 20_000]
    rows = [(i if i % 5 else None, x, "en", "s" if i % 2 else None, 0.5, "a", 1, "b") for i, x in enumerate(texts)] + [(2, base, "en", "s", 0.5, "a", 1, "b")] * 2
    schema = "doc_id long, text string, lang string, source string, toxicity_score double, mix_copy string, k1 long, row string"
    docs = spark.createDataFrame(rows, schema)
    for data in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, data, sf)
            got = out.collect()
            if name == "byte_bpe":
                assert len(got) == data.count() and all(r["round_trip"] for r in got)
                break
            assert out.columns == docs.columns
            if not data.isEmpty():
                kept = [r["text"] for r in got]
                assert {"toxicity": 10, "near_duplicates": 5, "mix": None}[name] in (len(got), None)
                if name == "near_duplicates":
                    assert sorted(map(str, kept)) == sorted(map(str, [base, None, "", "alone here", texts[-1]]))
                if name == "mix":
                    assert set(kept) <= {base, "alone here", texts[-1]} and max(map(kept.count, kept)) <= 2
            data = spark.createDataFrame(got, schema)
