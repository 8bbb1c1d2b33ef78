"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns: every operator and stage."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poolwright.llm import exact_dedup, minmax_dedup, mixing, packing, quality_gam, quality_rules, sharding, suffix_dedup, token_count, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, _n long, _text string, size long, shard int, count long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
PLAIN = " ".join(f"Word{i}" for i in range(80)) + "."


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, "x", 7, "y", 1, 2, 3) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, PLAIN, "a"), (1, PLAIN, "a"), (2, PLAIN.replace(" ", "\n "), "b"), (3, None, None), (4, "", "a"), (5, " \t\n", "b"),
    (None, "no id here", "a"), (None, PLAIN, None), (6, LONG, "c"), (7, "one", "c"), (8, "one", "c"), (7, "other text", "c"),
    (9, "naïve Ünïcode 漢字 \U0001f600 " * 30, "é"), (10, "#*$ | & " * 40, "b"), (11, "same same same " * 60, "b"),
]


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), 0) for i in range(1, 12)] + [(1, 0, 1), (None, 1, 0), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return make(spark, [])


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_sharding(docs, none):
    out = sharding.assign_shards(docs, 4, rows_each=3, least_buckets=1)
    assert out.columns == [*docs.columns, "_shard", "_slot"]
    assert counted(out, *docs.columns) == counted(docs, *docs.columns)
    assert sorted(counted(out, "_shard").values()) == [3, 4, 4, 4]
    assert sharding.assign_shards(none, 4).count() == 0
    few = sharding.assign_shards(docs.filter("doc_id = 6"), 40).collect()
    assert [(r["_shard"], r["_slot"]) for r in few] == [(0, 0)]


def test_exact_dedup(docs, none):
    got = {(r["_id"], r["keep_id"], r["group_size"], r["kept"], r["_copy"]) for r in exact_dedup.groups(docs).collect()}
    assert {(1, 1, 4, True, 1), (1, 1, 4, False, 2), (2, 1, 4, False, 1), (None, 1, 4, False, 1)} <= got
    assert {(3, 3, 2, True, 1), (4, 3, 2, False, 1), (7, 7, 2, True, 1), (8, 7, 2, False, 1), (5, 5, 1, True, 1)} <= got
    assert (None, None, 1, True, 1) in got
    stay = exact_dedup.unique(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter([1, 3, 5, None, 6, 7, 7, 9, 10, 11])
    assert exact_dedup.groups(none).count() == 0 and exact_dedup.unique(none).count() == 0


def test_near_duplicates(docs, none):
    got = {(r["_id"], r["_n"], r["component_id"]) for r in minmax_dedup.near_duplicates(docs).collect()}
    assert {(1, 76, 1), (2, 76, 1), (None, 76, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (7, 1, 7), (8, 1, 7), (None, 1, None)} <= got
    stay = minmax_dedup.unique(docs)
    assert stay.columns == docs.columns
    assert Counter(r.doc_id for r in stay.collect()) == Counter([1, 3, 4, 5, None, 6, 7, 7, 9, 10, 11])
    assert minmax_dedup.near_duplicates(none).count() == 0 and minmax_dedup.unique(none).count() == 0


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert out.filter("_copies > 2 or _copies < 0").count() == 0
    again = mixing.mix(docs)
    assert counted(out, "doc_id", "_copies") == counted(again, "doc_id", "_copies")
    many = mixing.repeated(docs)
    assert many.columns == docs.columns and many.count() == out.agg(F.sum("_copies")).first()[0]
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0
    empty = mixing.mix(docs.filter("doc_id in (3, 4)")).collect()
    assert {(r["_target"], r["_copies"]) for r in empty} == {(0.0, 0)}


def test_packing(docs, none):
    out = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in out if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert all(r.length == 1 and r.start == 0 for r in out if r.doc_id in (3, 4))
    assert len([r for r in out if r.doc_id == 6]) > 10
    assert packing.pack_documents(none).count() == 0


def test_suffix_dedup(docs, none):
    out = {(r.doc_id, len((r.text or "").encode())): (r["_n_removed"], len(r["_spans"])) for r in suffix_dedup.deduplicated(docs).collect()}
    assert out[1, len(PLAIN)] == (len(PLAIN), 1) and out[3, 0] == (0, 0) and out[7, 3] == (0, 0)
    assert out[11, 900] == (900, 1)  # it repeats itself
    assert suffix_dedup.deduplicated(docs).columns == [*docs.columns, "_n_removed", "_spans", "_kept"]
    assert suffix_dedup.deduplicated(none).count() == 0


def test_quality_model(docs, labels, none):
    out = quality_gam.rate(docs, labels)
    assert out.count() == docs.count() and out.filter("_score is null or _score < 0 or _score > 1").count() == 0
    assert quality_gam.accepted(docs, labels).columns == docs.columns
    unknown = quality_gam.rate(docs, labels.limit(0))
    assert {round(r["_score"], 6) for r in unknown.collect()} == {0.5}
    assert quality_gam.rate(none, labels).count() == 0


def test_quality_rules(docs, labels, none):
    out = {(r.doc_id, r["_judged"].n_words): r["_judged"] for r in quality_rules.judge(docs, labels).collect()}
    assert out[3, 0].base_failed and not out[3, 0].kept and out[11, 180].n_repeat_words == 180 and out[11, 180].base_failed
    assert out[10, 120].n_symbols == 200 and out[6, 60_000].word_chars == len(LONG.replace(" ", ""))
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).count() == docs.count()


def test_token_counts(docs, none):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    out = {(r.doc_id, r.text): r.n.n_tokens for r in docs.withColumn("n", token_count.token_counts(F.col("text"), path)).collect()}
    assert out[3, None] == out[4, ""] == 0 and out[6, LONG] > 60_000
    assert none.withColumn("n", token_count.token_counts(F.col("text"), path)).count() == 0


URLS = [
    None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://xorg/", "http://a.org",
    "http://a.com/fr/", "http://a.com/de/x.html", "http://a.com/en/x", "http://b.net/?q=1&r=2", "x://ÄB.net/p#f?g", "u://v://w/",
    "http://" + "long" * 5000 + ".com/fr/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(0, None, "a", "b")], "page_id long, url string, html string, _url string")
    out = url_filter.judge(pages)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict", "method"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got[0][:3] == got[1][:3] == got[2][:3] == ("", "", None)
    assert got[4] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[5] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[6][2] is None and got[7][2] is None and got[7][:2] == ("a.org", "")
    assert got[8] == ("a.com", "/fr/", "com/fr/", "allow") and got[9][2:] == ("com/de/", "block")
    assert got[12][:2] == ("Äb.net", "/p") and got[13][:2] == ("v:", "//w/") and got[14][2:] == ("com/fr/", "allow")
    assert {g[3] for g in got.values()} <= {"allow", "block"} and out.count() == len(URLS) + 1
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages.filter("page_id < 3")).collect()} == {"allow"}


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for start in (docs, none):
        kept = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == docs.columns, name
            kept.write.parquet(f"{tmp_path}/{re.sub(' ', '_', name)}{start is docs}")
            kept = spark.read.parquet(f"{tmp_path}/{re.sub(' ', '_', name)}{start is docs}")
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
        assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == Counter(r.doc_id for r in kept.collect())


#: Names that operators give their results or use inside.
TAKEN = (
    "_row _bucket _bits _slot _b _p _byte _may _id _text _in _key _n _times _n_removed _spans _kept _size _source_size _target _copies _copy _shard"
    " _score _predicted _judged _place _rank _digest _stratum _tie _of _label _third host path rule verdict method kept keep_id group_size n h1 h2"
    " word _run _doc _w conv pos depth chars k1 k2 p1 p2 ends own role turn _d _lo _hi _at _node _comp _sha a b u v component_id piece start length ids"
).split()


def test_every_name_is_taken(spark, labels):
    from poolwright.llm import prefix_trie, spelling, toxicity

    rows = spark.createDataFrame([(i, t, s) for i, t, s in ROWS if i != 6], "doc_id long, text string, source string")
    docs = rows.select("*", *[F.lit("x").alias(c) for c in TAKEN])
    n = docs.count()

    def whole(out, *added, rows=n):
        assert out.columns == [c for c in docs.columns if c not in added] + list(added)
        assert len(out.collect()) == rows

    whole(sharding.assign_shards(docs, 4), "_shard", "_slot")
    assert len(exact_dedup.groups(docs).collect()) == n and len(minmax_dedup.near_duplicates(docs).collect()) == n
    whole(exact_dedup.unique(docs), rows=9)
    whole(minmax_dedup.unique(docs), rows=10)
    whole(mixing.mix(docs), "_size", "_source_size", "_target", "_copies")
    assert mixing.repeated(docs).columns == docs.columns
    assert packing.pack_documents(docs).filter("piece = 0").count() == n
    whole(suffix_dedup.deduplicated(docs), "_n_removed", "_spans", "_kept")
    whole(quality_gam.rate(docs, labels), "_score", "_predicted")
    whole(quality_rules.judge(docs, labels), "_judged")
    whole(toxicity.rate(docs, labels), "_score", "_predicted")
    whole(url_filter.judge(docs.withColumn("url", F.concat(F.lit("http://a."), F.col("source"), F.lit("/fr/"))), url="url").drop("url"), "host", "path", "rule", "verdict", "method")
    assert spelling.spellings(docs).count() == 1
    assert prefix_trie.conversation_trie(docs.withColumn("conv_id", F.col("doc_id"))).count() > 5
