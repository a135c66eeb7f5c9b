import re

from pyspark.sql import functions as F

from citewell.functions import query_terms as Q
from citewell.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


def test_slugs_and_keys(spark):
    assert one(spark, T.slugify(F.col("x")), x="草莓：酸甜可口的浆果类水果") == "草莓-酸甜可口的浆果类水果"
    assert one(spark, T.slugify(F.col("x")), x=" -- ") == "untitled"
    assert one(spark, T.alias_keys(F.col("x")), x="Open AI notes") == ["openai", "openainotes"]
    assert one(spark, T.normalize_alias(F.col("x")), x="A b-C 1") == "abc1"
    assert one(spark, T.summarize(F.col("x"), 10), x="one two  three four") == "one two..."


def test_claim_lines(spark):
    lines = {"Title: a b c d": False, "# a b c d": False, "- this is one claim": True, "only three words": False, "what comes next is:": False, "1 2 3 4": False, "Overview.": False, "": False}
    rows = spark.createDataFrame([(x,) for x in lines], "x string").select("x", T.is_claim(F.col("x")).alias("c")).collect()
    assert {r.x: r.c for r in rows} == lines


def test_titles(spark):
    assert one(spark, T.title(F.col("x"), F.lit("none")), x="\n  # Head \nbody") == "Head"
    assert one(spark, T.title(F.col("x"), F.lit("none")), x="  \n") == "none"
    assert one(spark, T.heading(F.col("x")), x="## a b ##") == "a b ##"


def test_confidence(spark):
    assert one(spark, T.confidence(F.col("l"), F.col("c")), l="line:3;section:x", c="cited") == "cited"
    assert one(spark, T.confidence(F.col("l"), F.col("c")), l="page:3", c="cited") == "weak"
    assert one(spark, T.confidence(F.col("l"), F.col("c")), l="line:0", c="sure") == "weak"
    assert one(spark, T.confidence(F.col("l"), F.col("c")), l="line:3", c="Weak") == "cited"
    assert one(spark, T.confidence(F.col("l"), F.col("c")), l="", c="Uncited") == "uncited"


def test_safe_filename(spark):
    for name, want in (("a/b/My Notes (1).MD", "My-Notes-1.md"), ("???.txt", "source.txt"), ("", "source"), (".hidden", ".hidden"), ("x.tar.GZ", "x.tar.gz")):
        assert one(spark, T.safe_filename(F.col("n")), n=name) == want


def test_json_in_replies(spark):
    reply = 'Here:\n```json\n{"a": {"score": 1}}\n```'
    assert one(spark, T.bare_object(F.col("r")), r=reply) == '{"a": {"score": 1}}'
    assert one(spark, T.bare_object(F.col("r")), r="nothing") is None
    names = ("claim_id", "score")
    assert one(spark, T.json_keys(F.col("j"), names), j='{"a": [{"score" : 1}], "b": "\\"claim_id\\": x"}') == ["score"]
    assert one(spark, T.json_keys(F.col("j"), names), j='{"a": "score"}') == []


def test_question_features(spark):
    asked = spark.createDataFrame([(1, "草莓应该怎么保存？"), (2, "维生素Ｃ水果"), (3, "H₂O 的性质"), (4, "E=mc² 表示什么？"), (5, "α/β ratio 怎么解释？"), (6, "🍎 营养")], "query_id int, question string")
    names = spark.createDataFrame([("草莓",), (" ",)], "term string")
    got = {r.query_id: r for r in Q.analyze(asked, names).collect()}
    assert got[1].normalized.endswith("?") and got[1].catalog_terms == ["草莓"]
    assert {"草莓", "保存"} <= set(got[1].text_terms) and set(got[1].stop_terms) == {"应该", "怎么"}
    assert {"冷藏", "储存"} <= set(got[1].expanded_terms)
    assert got[2].normalized == "维生素C水果" and {"维生素C", "维生素"} <= set(got[2].text_terms)
    assert {"H₂O", "H2O"} <= set(got[3].formula_spans) and {"E=mc²", "E=mc2"} <= set(got[4].formula_spans)
    assert "α/β" in got[5].symbol_spans and "ratio" in got[5].text_terms
    assert "🍎" in got[6].symbol_spans and "营养" in got[6].text_terms


def test_whole_benchmark_texts_are_analyzed(spark, tmp_path):
    from citewell.queries import QUERIES

    items = {1: "filler words that fill the first forty characters, then klingon archive late_word", 2: "short archive", 3: "x1 " * 30 + "B12 at the end", 4: None}
    spark.createDataFrame([(1, "Some claim of four words.", "klingon", "archive", 25)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.query_id: r for r in QUERIES["q1_q7_analyze"](spark, str(tmp_path)).collect()}
    assert got.keys() == items.keys()
    for i, text in items.items():
        names = [n for n in ("klingon archive", "archive", "klingon") if n in (text or "")]
        assert got[i].catalog_terms == ",".join(names)
        words = list(dict.fromkeys(re.findall("[A-Za-z0-9_]{2,}", text or "")))
        assert [t for t in got[i].text_terms.split(",") if t in words and t not in names] == [w for w in words if w not in names]
    assert "B12" in got[3].formula_spans.split(",")
