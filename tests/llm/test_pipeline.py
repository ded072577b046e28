"""The pipeline over small tables with planted cases, stage by stage."""

import random

import corpus_pipeline
from ledgerflow.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = {"en": ["the", "th", "ing", "er", "and", "on"], "de": ["sch", "ung", "ich", "der", "ü", "en"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(words))


def tables(spark, path, rows, items):
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_planted_cases(spark, tmp_path):
    rng = random.Random(5)
    lang = lambda i: ("en", "de")[i % 2]
    rows = [(i, "\n".join(prose(rng, lang(i), 30) for _ in range(3)), lang(i)) for i in range(60)]
    item = prose(rng, "en", 25)
    clean = {i for i, _, _ in rows}
    rows += [(100, rows[3][1], "de"), (101, rows[4][1].replace("the", "the", 1) + " x", "en")]  # an exact and a near copy
    rows += [(102, prose(rng, "en", 20) + " " + item.upper() + " " + prose(rng, "en", 20), "en")]  # a leak
    rows += [(103, "123 456 !!", "en"), (104, None, "en"), (105, "", None), (106, "The.", "en")]
    tables(spark, str(tmp_path), rows, [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert [c for c, _ in docs.dtypes] == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert seen[0] == clean | {100, 101, 102, 106}  # no language: 103 to 105
    assert 100 not in seen[1] and 101 not in seen[2] and 102 in seen[2] and 102 not in seen[3]
    assert seen[4] == clean | {106}
    assert all(r.round_trip for r in docs.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 11)] + ["pipeline"]
    assert set(queries.oracle_sql()) <= set(names)


def test_rows_that_share_an_id_have_their_own_verdicts(spark, tmp_path):
    rng = random.Random(7)
    text = [prose(rng, "en", 60) for _ in range(6)]
    item = prose(rng, "en", 25)
    rows = [(None, text[0], "en"), (None, "123 456 !!", "en"), (None, text[1] + " " + item, "en"), (None, text[2], "en"), (None, text[2], "en")]
    rows += [(8, text[3], "en"), (8, text[4], "en"), (8, text[4], "en"), (8, "!!", "en"), (8, text[5] + " " + item, "en"), (5, text[3], "en")]
    tables(spark, str(tmp_path), rows, [(1, item)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: sorted(r.text for r in df.collect())
    letters = [t for _, t, _ in rows if "!!" not in t]
    assert texts(corpus_pipeline.identified(spark, docs, str(tmp_path))) == sorted(letters)
    assert texts(corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path))) == sorted(t for _, t, _ in rows if item not in t)
    kept = corpus_pipeline.one_of_each(spark, docs.where("text not like '%!!'"), str(tmp_path))
    assert kept.columns == docs.columns and texts(kept) == sorted(set(letters))
    assert {r.doc_id for r in kept.collect() if r.text == text[3]} == {5}  # the unique texts of id 8 stay
