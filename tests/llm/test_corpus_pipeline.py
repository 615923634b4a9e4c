"""The corpus pipeline on planted cases: what must go goes, clean documents stay."""

import random

import corpus_pipeline
from boardlake.llm.tokens import public_path, token_ids


def test_pipeline_on_planted_cases(spark, tmp_path):
    r = random.Random(7)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    vocab = [word() for _ in range(3000)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs = [(i, text(r.randrange(60, 200))) for i in range(300)]
    toxic = set(range(0, 300, 6))
    docs = [(i, t + (" you scumbag idiot " + t.split()[0] + " idiot scumbag" if i in toxic else "")) for i, t in docs]
    passage = text(40)
    docs += [(400, docs[1][1]), (401, docs[2][1] + " tail"), (402, text(90) + " " + passage + " " + text(30)), (403, text(50) + " write to ann.b@mail.example.com now"), (404, None), (405, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x.doc_id: x.text for x in at.collect()})
    assert not toxic & set(kept[0]) and set(kept[0]) == {i for i, _ in docs} - toxic
    assert 1 in kept[1] and 400 not in kept[1] and 2 in kept[1] and 402 in kept[1]
    assert passage not in kept[2][402] and kept[2][3] == dict(docs)[3]
    assert "[EMAIL]" in kept[3][403] and "ann.b@" not in kept[3][403]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    enc = token_ids(public_path("word_bpe_49k.json"))
    total = sum(len(enc.whole(t or "")) // 4 + 1 for t in kept[3].values())
    assert {x.doc_id for x in packed} == set(kept[3]) and sum(x.length for x in packed) == total
