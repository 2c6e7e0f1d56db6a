"""Extra columns whose names clash with those that operators use inside."""

import re
from pathlib import Path

import corpus_pipeline
from lexmill.llm import chat, queries

from .conftest import prose

FOLDER = Path(chat.__file__).parent


def inner_names():
    """Every plain name in quotes in the subpackage's code."""
    made = {"_domain", "_lang", "_source", "_whole", "_cut", "_epoch"}
    return sorted(made | {m for path in FOLDER.glob("*.py") for m in re.findall(r"""["'](_?[a-z][a-z0-9_]{0,16})["']""", path.read_text())})


def widened(df):
    taken = set(df.columns)
    names = [n for n in inner_names() if n not in taken]
    assert {"_scan", "_domain", "_whole", "_epoch", "_tox", "_fp_kept", "_i", "key", "place", "e"} - taken <= set(names)
    return df.selectExpr("*", *(f"{k} AS `{n}`" for k, n in enumerate(names))), names


def test_every_query_and_stage(spark, tmp_path):
    import random

    rng = random.Random(2)
    text = [prose(rng, 40) for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate([*text, text[0], None, ""])], "doc_id long, text string, lang string, source string, n_chars long")
    tables = {
        "documents": docs, "labels": docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 2 AS int) AS toxic"), "benchmark": docs.where("doc_id = 2").selectExpr("doc_id AS item_id", "substr(text, 5, 90) AS text"),
        "pages": docs.selectExpr("doc_id AS page_id", "concat('http://a.net/', doc_id) AS url", "text AS html"), "conversations": docs.selectExpr("doc_id AS conv_id", "doc_id AS turn", "'user' AS role", "text"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/plain/{name}.parquet")
        widened(df)[0].coalesce(1).write.parquet(f"{tmp_path}/wide/{name}.parquet")
    for name, query in queries.queries().items():
        plain, wide = (query(spark, f"{tmp_path}/{side}") for side in ("plain", "wide"))
        assert plain.columns == wide.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, wide.collect())), name
    whole = spark.read.parquet(f"{tmp_path}/wide/documents.parquet")
    names = widened(docs)[1]
    want = {n: k for k, n in enumerate(names)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, whole, f"{tmp_path}/wide")
        more = [c for c in out.columns if c not in whole.columns]
        assert out.columns == whole.columns + more and more == (["__epoch"] if name == "source_mixing" else []), name
        rows = out.collect()
        assert rows and all(r[n] == k for r in rows for n, k in want.items()), name
