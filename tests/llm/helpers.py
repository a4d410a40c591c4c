"""Small tables and plain Python versions shared by the tests of the llm subpackage."""

import hashlib

# Texts with empty, very short, repeated, odd and long content.
LONG = " ".join(f"word{i % 701} thing{i % 13}" for i in range(6000))
TEXTS = [
    "The quick brown fox jumps over the lazy dog and runs away from the loud farmer in the field.",
    "The quick brown fox jumps over the lazy dog and runs away from the loud farmer in the field.",
    None, "", " ", "a", "one two three", "\n\n tab\tand  spaces \n", "é è ê ñ ü 日本語 テキスト 🙂", "x" * 3000, LONG, LONG + " end", "a▁b <s> </s> \x00 z",
]


def documents(spark, texts=TEXTS, **extra):
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
