from collections import Counter

import corpus_pipeline
from lexmill.llm import mixing

from .conftest import prose
from .test_llm import components, plain_contamination, plain_mix, toxic_corpus
from .test_whole import similar


def test_pipeline(spark, tmp_path):
    import random

    rng = random.Random(11)
    data = toxic_corpus(rng, 300)
    docs = [(i, t, "en", f"src{i % 5}", len(t)) for i, t, _ in data]
    docs += [(400 + k, docs[1][1], "de", "src1", docs[1][4]) for k in range(4)]
    passage = prose(rng, 14)
    docs += [(500, prose(rng, 20) + " " + passage + " " + prose(rng, 20), "en", "src2", 0), (501, prose(rng, 30) + " password = hunter2hunter2", "fr", "src3", 0)]
    docs += [(600, None, None, None, None), (601, "", "en", "src1", 0)]
    words = prose(rng, 200).split()
    for k in range(3):  # near copies, each a few words on from the one before
        docs.append((700 + k, " ".join(words), "en", "src4", 0))
        words[20 + 50 * k : 24 + 50 * k] = [f"new{k}{j}" for j in range(4)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    left = {d[0]: d for d in docs if not (d[0] < 300 and data[d[0]][2])}
    ids = sorted(left)
    group = components(len(ids), similar([left[i][1] for i in ids]))
    left = {i: left[i] for k, i in enumerate(ids) if group[k] == k}
    assert not {400, 601, 701, 702} & set(left) and 700 in left
    dirty = {k[0] for k in plain_contamination([(i, d[1]) for i, d in left.items()], [(1, passage)]) if k[5]}
    assert dirty == {500}
    final = [dict(zip(("doc_id", "text", "lang", "source"), d[:4], strict=True)) for i, d in left.items() if i not in dirty]
    for r in final:
        if r["doc_id"] == 501:
            r["text"] = r["text"].replace("password = hunter2hunter2", "[SECRET]")
    assert Counter((r["doc_id"], r["_epoch"]) for r in got) == plain_mix(final, mixing.Plan())
    assert all("hunter2" not in (r["text"] or "") for r in got)
    assert len(corpus_pipeline.STAGES) == 5
