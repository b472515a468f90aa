"""Small document tables, odd rows included."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _digest string, _kept string, block int, tie double, entity string"
WORDS = {
    "en": "the of and to in that was with for have from they this which one had word but what some we can out other were all there when up use your how said an each she".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(spark, texts, langs=None):
    """Rows of text with ids 0.., and columns whose names operators use inside."""
    rows = [(i, t, langs[i] if langs else "en", "s", len(t) if t is not None else None, "x", "y", i, 0.5, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd(spark):
    """Null ids, texts and languages, empty and very long texts, repeated rows, ids that clash."""
    rng = random.Random(3)
    long = sentence(rng, "en", 30_000)
    rows = [
        (0, "the cat sat on the mat and saw the dog run over the hill in the sun", "en"),
        (0, "the cat sat on the mat and saw the dog run over the hill in the sun", "en"),
        (1, None, "en"), (2, "", None), (3, "   \n\t ", "de"), (None, "a text of no name that says the same as no other text here", None),
        (4, long, "en"), (4, "another text with the id of the long one and words of its own", "en"), (5, "x" * 5000, "de"), (6, "!!! ???", "en"),
        (None, None, None), (7, "日本語 テキスト é \U0001f600 ▁ mark", "fr"),
    ]
    return spark.createDataFrame([(i, t, lang, None, None, None, None, None, None, None) for i, t, lang in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def mixed(n: int = 60, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return [sentence(rng, "en" if i % 2 else "de", rng.randint(3, 60)) for i in range(n)]
