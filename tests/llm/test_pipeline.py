import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as cp
from freshet.llm import subword_langid, toxic_channel
from freshet.llm.registry import tokenizer_file
from tests.llm.helpers import LONG, sha
from tests.llm.test_classifiers import corpus
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_signature_tree import brute as brute_components
from tests.llm.test_signature_tree import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash int"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    toxic = corpus(240)
    texts = [t for _, t, _ in toxic]
    item = " ".join(f"question{i}" for i in range(14))
    texts += near_copies(rng, 3, 8, 3) + [f"plain start {item} and end", item, item, "", None, "123 --- 456", LONG, LONG, "bl0ckhead " + texts[1], "a b", "a b"]
    rows = [(i + 10, t, "en" if i % 3 else "xx", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    root = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i + 10, 1, t) for i, _, t in toxic], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, rows


def test_like_plain_python(spark, made):
    root, rows = made
    docs = spark.read.parquet(f"{root}/documents.parquet")
    scorer = toxic_channel.train(docs, spark.read.parquet(f"{root}/labels.parquet"), F.lit(True))
    kept = [r for r, s in zip(rows, scorer.score([(r[1] or "").encode() for r in rows])) if s < 0.5]
    assert 0.6 * len(rows) < len(kept) < 0.8 * len(rows)
    model = subword_langid.train(spark.createDataFrame(kept, SCHEMA), F.lit(True))
    rejected = model.predict([(r[1] or "").encode() for r in kept])[2]
    kept = [r for r, no in zip(kept, rejected) if not no]
    least = brute_components([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if least[i][1] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    hits = brute_hits([r[1] for r in kept], items)
    kept = [r for i, r in enumerate(kept) if not hits[i][1]]
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    expected = {r[0]: (len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for r in kept for i in [library.encode(r[1])]}
    found = {r["doc_id"]: tuple(r[1:]) for r in cp.run(spark, root).collect()}
    assert found == expected


def test_stages_keep_the_columns_and_clean_rows(spark, made):
    root, rows = made
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["toxicity", "language_id", "near_copies", "decontamination", "sentencepiece"]
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns, name
        assert out.join(docs, docs.columns, "left_anti").filter("text is not null").count() == 0
    assert stage(spark, docs.limit(0), root).count() == 0


def test_one_of_each_with_tied_keys(spark):
    from freshet.llm import signature_tree

    rows = spark.createDataFrame(
        [(2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f"), (5, ""), (5, ""), (None, "x y z"), (1, "x y z"), (None, "q r s")], "doc_id long, text string"
    )
    left = sorted(((r[0] or 0), r[1]) for r in signature_tree.one_of_each(rows).collect())
    assert left == [(0, "q r s"), (1, "x y z"), (2, "a b c d e f"), (5, ""), (5, "")]
