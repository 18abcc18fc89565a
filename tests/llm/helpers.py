"""Small document tables for the tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, fp string"


def documents(spark, rows, schema=DOCS):
    """``rows`` of (doc_id, text[, lang[, source]]); columns that clash with result names are added."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, "x", "y", "z") for r in full], schema)


WORDS = {
    "en": "the of and that with from for this was are have which there people water under house".split(),
    "de": "der die und nicht mit auf für über straße größe haben werden schön wasser unter haus".split(),
    "fr": "le la les été être avec pour dans très français maison sous que vous nous où".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, sentence(rng, lang := rng.choice(list(WORDS)), rng.randint(5, 40)), lang, f"s{i % 3}") for i in range(n)]
