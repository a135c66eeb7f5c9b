"""Similar titles by prefixes against all pairs, with a word that every title has."""

import random

from citewell.operators import quality


def test_similar_titles_with_a_word_in_all(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(30)]
    titles = {f"p{i:03d}": " ".join(["common", *rng.sample(words, rng.randint(0, 7))]) for i in range(150)} | {"e": "", "n": None, "s": "a b", "one": "word1"}
    pages = spark.createDataFrame(list(titles.items()), "page_id string, title string")
    wanted = pages.filter("page_id < 'p040' OR page_id >= 'p140' OR page_id < 'p'").withColumnRenamed("page_id", "wanted_id")
    sets = {k: {w for w in (t or "").split() if len(w) >= 3} for k, t in titles.items()}
    near = lambda a, b: len(a & b) >= 2 and 2 * len(a & b) >= min(len(a), len(b))
    asked = [r.wanted_id for r in wanted.collect()]
    got = [tuple(r) for r in quality.similar_titles(pages, wanted).collect()]
    assert sorted(got) == sorted((w, p) for w in asked for p in titles if near(sets[w], sets[p])) and len(got) == len(set(got)) > 100
    counts = spark.createDataFrame([("common", 150), *((w, 30) for w in words)], "token string, titles int")
    held = quality.title_prefixes(pages.withColumnRenamed("page_id", "id"), counts)
    assert held.filter("token = 'common'").count() == 0
    assert quality.similar_titles(pages.limit(0), wanted).count() == 0
