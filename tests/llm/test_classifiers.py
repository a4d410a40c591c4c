import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import common, subword_langid, toxic_channel
from tests.llm.helpers import LONG, TEXTS, documents


def test_languages_of_held_out_documents(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    held = common.remainder("doc_id", 4) == 2
    model = subword_langid.train(docs, ~held)
    rows = subword_langid.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter(held).collect()
    right = np.mean([r["lang"] == r["lang_pred"] for r in rows])
    assert right > 0.97 and np.mean([r["rejected"] for r in rows if r["lang"] == r["lang_pred"]]) <= 0.01
    sure = [r["lang"] == r["lang_pred"] for r in rows if r["score"] > 0.95]
    assert np.mean(sure) > 0.98 and 0 < model.floor < 1
    # lang, source and doc_id do not enter a prediction
    moved = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    again = {r["doc_id"] - 7: (r["lang_pred"], r["score"]) for r in subword_langid.predict(moved, model).collect()}
    assert all(again[r["doc_id"]] == (r["lang_pred"], r["score"]) for r in rows)


def test_language_rows(spark):
    texts = [*TEXTS, "123 --", "le la les", "le la les"]
    rows = documents(spark, texts).withColumnRenamed("source", "score")
    model = subword_langid.train(rows, F.lit(True))
    found = {r["doc_id"]: r for r in subword_langid.predict(rows, model).collect()}
    for i, text in enumerate(texts):
        letters = any(c.isalpha() for c in text or "")
        assert found[i]["lang_pred"] == ("en" if letters else "und") and found[i]["rejected"] == (not letters)
        assert 0 <= found[i]["score"] <= 1
    assert subword_langid.recognised(rows, model).columns == rows.columns
    assert subword_langid.recognised(rows, model).count() == sum(any(c.isalpha() for c in t or "") for t in texts)
    none = subword_langid.train(rows.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in subword_langid.predict(rows, none).collect()} == {"und"}
    assert subword_langid.predict(rows.limit(0), model).count() == 0


# Plain sentences of our own in languages that no document is labelled with.
UNSEEN = [
    "Wczoraj wieczorem poszliśmy na długi spacer brzegiem rzeki i rozmawialiśmy o dawnych czasach.",
    "Eilen illalla kävelimme pitkään joen rannalla ja puhuimme vanhoista ajoista ystävien kanssa.",
    "Dün akşam nehir kıyısında uzun bir yürüyüş yaptık ve eski günlerden konuştuk.",
    "Tegnap este hosszú sétát tettünk a folyó partján és a régi időkről beszélgettünk.",
    "Вчера вечером мы долго гуляли по берегу реки и говорили о старых временах.",
    "昨天晚上我们沿着河边走了很久，谈起了从前的日子和老朋友。",
    "Χθες το βράδυ περπατήσαμε πολλή ώρα δίπλα στο ποτάμι και μιλήσαμε για τα παλιά.",
    "مشينا مساء أمس طويلا على ضفة النهر وتحدثنا عن الأيام القديمة مع الأصدقاء",
    "Jana jioni tulitembea kwa muda mrefu kando ya mto na kuzungumza juu ya zamani.",
    "Tối qua chúng tôi đi dạo rất lâu bên bờ sông và nói chuyện về những ngày xưa.",
]


def gibberish(n, seed=1):
    """Runs of consonants, and words with two or three letters over and over."""
    rng = np.random.default_rng(seed)
    out = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(20)) for _ in range(n)]
    return out + [" ".join(["".join(rng.choice(list("qxzjkvw"), 3))] * 12) for _ in range(n)]


def test_strange_texts_are_rejected(spark, sf):
    """Nine of ten texts of no learned language go, 99 of 100 right ones of every language stay."""
    docs = spark.read.parquet(sf.replace("0.001", "0.1") + "/documents.parquet")
    held = common.remainder("doc_id", 4) == 2
    model = subword_langid.train(docs, ~held)
    for texts in (UNSEEN, gibberish(150)):
        assert np.mean(model.predict([t.encode() for t in texts])[2]) >= 0.9
    rows = subword_langid.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").filter(held & F.col("lang").isNotNull()).collect()
    right = [r for r in rows if r["lang"] == r["lang_pred"]]
    assert len(right) > 0.97 * len(rows) and np.mean([r["rejected"] for r in right]) <= 0.01
    assert subword_langid.LEAST_APART * 10 < len(right) and 0.01 < model.temperature < 100


def test_every_label_is_learned(spark):
    """More labels than a sample has rows for each: all are learned, none by its number of rows."""
    rng = np.random.default_rng(2)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{k:03}": ["".join(rng.choice(letters, 5)) for _ in range(6)] for k in range(90)}
    rows = [(i, " ".join(rng.choice(words[f"l{i % 90:03}"], 30)), f"l{i % 90:03}") for i in range(2700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = subword_langid.train(df, F.lit(True))
    assert len(model.languages) == 90
    found, _, _ = model.predict([t.encode() for _, t, _ in rows[:900]])
    assert np.mean([f == r[2] for f, r in zip(found, rows)]) > 0.9


def test_sample_of_a_long_text_is_bounded(spark):
    known = np.zeros(1 << subword_langid.GRAM_BITS, bool)
    texts = [" ".join(f"w{i}x{i * i}abc{i % 97}y" for i in range(20_000)), "short text here"]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([False, True]), pa.array([t.encode() for t in texts], pa.binary())], ["l", "a", "t"])
    made = [b for b in subword_langid._sample_rows(iter([batch]), known)]
    sizes = [len(x) for b in made for x in b.column(3).to_pylist()]
    assert sizes[0] < 1.3 * subword_langid.SAMPLE_SUBWORDS and sizes[1] > 10


CLEAN = "the weather of the valley was fine and they went for a walk along the river with a dog called rex"
BAD = ("blockhead", "numbskull", "snotface", "wretched")


def corpus(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in ("ba", "ri", "to", "me", "lun", "sor") for b in ("na", "li", "tor", "wen") for c in ("", "s", "de", "ka")]
    rows = []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, 40)]
        toxic = i % 4 == 0
        if toxic:
            for k in rng.choice(4, 2, replace=False):
                text.insert(int(rng.integers(0, 40)), BAD[k])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


DISGUISES = ["bl0ckhead", "num8skull", "sn0tf4ce", "wr3tch3d", "w-r-e-t-c-h-e-d", "b l o c k h e a d", "snooootface", "numb$kull", "WRETCH3D", "b.l.o.c.k.h.e.a.d"]


def test_toxicity(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1)], "doc_id long, toxic int")
    held = common.remainder("doc_id", 5) == 0
    scorer = toxic_channel.train(docs, labels, ~held)
    found = {r["doc_id"]: r for r in toxic_channel.score(docs, scorer).collect()}
    assert np.mean([found[i]["predicted"] == t for i, _, t in rows]) > 0.99
    for word in DISGUISES:
        text = f"{CLEAN} {word} {CLEAN}".encode()
        assert scorer.score([text])[0] >= 0.5, (word, toxic_channel.restored(text, scorer.characters))
    harmless = [CLEAN, "", "call 555-1234 at 10.30", "a b c d", "x" * 500, "24be64439e3e49cf46b2 https://a.b/c?d=1 me@x.org", "!!! *** $$$ the end...", LONG]
    assert (scorer.score([x.encode() for x in harmless]) < 0.5).all()
    # copies of a toxic document do not make its other words toxic
    assert scorer.score([rows[1][1].encode()])[0] < 0.5


def test_disguised_words_among_many_digits(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    scorer = toxic_channel.train(docs, labels, F.lit(True))
    model = scorer.characters
    spans = [
        "bl0ckh34d-num85kull-5n0tf4c3-wr3tch3d", "1 2 3 4 5 6 7 8 b l o c k h e a d", "20240131bl0ckh34d", "id:12345678,bl0ckh34d",
        "你是bl0ckh34d和num85kull在2024年12月31日",
    ]
    for span in spans:
        assert scorer.score([f"{CLEAN} {span} {CLEAN}".encode()])[0] >= 0.5, (span, toxic_channel.restored(span.encode(), model))
    assert b"blockhead" in toxic_channel.restored(spans[0].encode(), model)
    codes = ["24be64439e3e49cf46b2", "2024-01-31", "+49-30-1234567", "550e8400-e29b-41d4-a716-446655440000", "1 2 3 4 5 6 7 8 9 0"]
    assert (scorer.score([f"{CLEAN} {x} {CLEAN}".encode() for x in codes]) < 0.5).all()


def test_restoration_leaves_plain_text_alone():
    texts = [CLEAN, "", "a", "it's 10% of 3.5, e.g. the U.S. (north) and so-called things!", "é ê ñ y a", "end.\nNext, 2nd"]
    counts = np.zeros(64**3, np.int64)
    model = toxic_channel.CharacterModel(counts)
    for text in texts[:3]:
        assert toxic_channel.restored(text.encode(), model) == text.encode()
    assert toxic_channel.disguised(np.frombuffer(b"id1ot $cum m00n sooon v-i-l-e", np.uint8)) == [(0, 5), (6, 10), (11, 15), (16, 21), (22, 29)]


def test_toxicity_rows(spark):
    rows = documents(spark, [*TEXTS, f"{CLEAN} x", f"{CLEAN} x"]).withColumnRenamed("source", "predicted")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scorer = toxic_channel.train(rows, none, F.lit(True))
    assert {r["score"] for r in toxic_channel.score(rows, scorer).collect()} == {0.0}
    assert toxic_channel.clean(rows, scorer).count() == rows.count() and toxic_channel.clean(rows, scorer).columns == rows.columns
    assert toxic_channel.score(rows.limit(0), scorer).count() == 0
    assert toxic_channel.train(rows.limit(0), none, F.lit(True)).score([b"x"])[0] == 0.0


def held_out_recall(spark, wrong):
    """{lang: (caught, toxic)} and the precision on held-out rows of sf0.1, with a share of wrong training labels."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").cache()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    chance = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(10_000)) / 10_000
    flipped = labels.withColumn("toxic", F.when(chance < wrong, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    held = common.remainder("doc_id", 5) == 0
    found = toxic_channel.score(docs, toxic_channel.train(docs, flipped, ~held)).join(labels, "doc_id").filter(held & F.col("toxic").isNotNull())
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    caught = {g: (sum(r["predicted"] for r in rows if r["lang"] == g and r["toxic"]), sum(1 for r in rows if r["lang"] == g and r["toxic"])) for g in ("en", "fr", "de", "es")}
    return caught, sum(r["predicted"] and r["toxic"] for r in rows) / max(sum(r["predicted"] for r in rows), 1)


@pytest.mark.parametrize("wrong", [0, 0.02, 0.05])
def test_toxic_documents_of_every_language(spark, wrong):
    caught, precision = held_out_recall(spark, wrong)
    share = {g: a / b for g, (a, b) in caught.items()}
    assert share["en"] >= 0.9 and share["fr"] >= 0.9 and share["de"] >= 0.8 and share["es"] >= 0.8 and precision >= 0.95, (caught, precision)


def test_rare_toxic_words_are_learned(spark):
    """A word of one in twenty toxic documents weighs; beside a common one it tips the scale further."""
    rows = corpus(2000)
    rare = [(i, f"{text} grumblefoot", t) if t and i % 80 == 0 else (i, text, t) for i, text, t in rows]
    docs = spark.createDataFrame([r[:2] for r in rare], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rare], "doc_id long, toxic int")
    scorer = toxic_channel.train(docs, labels, F.lit(True))
    plain, rare_only, common_word, both = scorer.evidence([f"{CLEAN} {x}".encode() for x in ("", "grumblef00t", "wretched", "wretched grumblef00t")])
    assert plain < rare_only < common_word < both and scorer.score([CLEAN.encode()])[0] < 0.5


def test_evidence_counts_how_often():
    """Weights add up over a text, occurrences by their logarithm, and a longer text needs more of them."""
    table = np.zeros(toxic_channel.BUCKETS, np.float32)
    table[[3, 9]] = 2.0, 1.0
    bucket, owner = np.array([3, 3, 3, 9, 5, 3] + [7] * 300), np.array([0, 0, 0, 0, 0, 1] + [1] * 300)
    found = toxic_channel.evidence(table, bucket, owner, 3)
    assert np.allclose(found, [(2 * 2 + 1) / np.sqrt(5 + toxic_channel.SHORT), 2 / np.sqrt(301 + toxic_channel.SHORT), 0])


def test_boundary():
    """The bound parts the classes with twice the care for precision; without any order nothing is toxic."""
    found, toxic = np.array([5.0, 4.0, 3.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 1, 0, 0])
    bound, slope = toxic_channel.boundary(found, toxic, np.ones(6))
    assert 3 < bound < 4 and slope > 0
    assert toxic_channel.boundary(np.zeros(4), np.array([1, 0, 1, 0]), np.ones(4))[0] == float("inf")


def every_reading(model, token):
    """The least cost of any reading of a disguised word, and its text, by trying all of them."""
    options, before = [], ""
    for c in token:
        own = [(x, toxic_channel.SIGN_COST) for x in toxic_channel.SIGNS.get(c, "")]
        if c in toxic_channel.SEPARATORS:
            own.append(("", toxic_channel.SEPARATOR_COST))
        elif c in toxic_channel.SIGNS:
            own.append(("", toxic_channel.DROP_COST))
        if c.isalpha():
            own += [(c, 0.0)] + ([("", toxic_channel.REPEAT_COST)] if c == before else [])
        options.append(own or [("", toxic_channel.SEPARATOR_COST)])
        before = c
    best = None
    for reading in itertools.product(*options):
        word = "".join(x for x, _ in reading)
        kinds = [0, 0, *toxic_channel._class_of(np.array([ord(x) for x in word], np.int64)).tolist(), 0]
        steps = [float(model.cost[a, b, c]) for a, b, c in zip(kinds, kinds[1:], kinds[2:])]
        cost = sum(p for _, p in reading) + sum(steps) - model.usual * len(word)
        best = min(best or (cost, word), (cost, word))
    return best


def test_viterbi_finds_the_cheapest_reading():
    rng = np.random.default_rng(5)
    model = toxic_channel.CharacterModel(rng.integers(0, 40, 64**3) * (rng.random(64**3) < 0.2))
    for _ in range(120):
        token = "".join(rng.choice(list("ab0138@$!.-*ees"), rng.integers(1, 7)))
        cost, word = every_reading(model, token)
        assert model._viterbi(token) == word, (token, word, cost)
