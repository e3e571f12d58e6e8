"""Every corpus operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import pipeline, registry
from tessera.llm.common import fold_of
from tessera.llm.decontamination import contaminated
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.fixity import audit
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.mixing import mix
from tessera.llm.quality import quality
from tessera.llm.secrets import scan, secret_digests
from tessera.llm.substring_dedup import without_repeats
from tessera.llm.token_counts import token_counts, tokenizer_path
from tessera.llm.toxicity import toxicity

# Columns that operators use inside, or return, under names of their own.
CLASHES = "row_no long, digest string, words string, leaf long, keep_id string, score string, h1 long, size string, u double, class string, source_size string, base string, removed string, pos int, id string, text_hash string, shard int, copy string, label string, rank string"
LONG = "palabra über " * 20_000
TEXTS = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same text here of six words"), (6, "same text here of six words"), (6, "same text here of six words"), (None, "no id"), (7, "one"), (2**60, "large id")]


@pytest.fixture(scope="module")
def odd(spark):
    names = CLASHES.split(", ")
    rows = [(i, t, "en", None if i == 1 else "s", 1, *[None] * len(names)) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (6, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")


BENCH = "item_id long, text string, words string, seed long"
LEARN = fold_of
OPERATORS = {
    "exact": lambda d, l, b: exact_dedup(d),
    "quality": lambda d, l, b: quality(d, l, fold_of("doc_id", 5) != 0),
    "secrets": lambda d, l, b: secret_digests(scan(d)),
    "tokens": lambda d, l, b: token_counts(d, tokenizer_path(), 512),
    "substrings": lambda d, l, b: without_repeats(d),
    "toxicity": lambda d, l, b: toxicity(d, l, fold_of("doc_id", 3) != 1),
    "jaccard": lambda d, l, b: jaccard_join(d),
    "mix": lambda d, l, b: mix(d, [5, 2, 1]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(spark, odd, labels, name):
    bench = spark.createDataFrame([(1, None, None, None)], BENCH)
    got = sorted((r["doc_id"] or -1) for r in OPERATORS[name](odd, labels, bench).select("doc_id").collect())
    assert got == sorted((i or -1) for i, _ in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0), spark.createDataFrame([], BENCH)).count() == 0


def test_contamination_edges(spark, odd):
    text = "these are the exact tokens that a question of the benchmark has in it"
    docs = odd.select("*").unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(50).cast("long")).withColumn("text", F.lit(f"start {text} end")))
    bench = spark.createDataFrame([(1, None, None, None), (2, "", None, None), (9, text, None, None), (8, text.upper(), None, None), (3, "too few", None, None)], BENCH)
    got = contaminated(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["n_equal_items"], r["score"], r["doc_token"]) for r in got] == [(50, 8, 2, 14, 1)]
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_values_of_odd_rows(spark, odd):
    kept = {(r["doc_id"], r["kept"]) for r in exact_dedup(odd).where("doc_id in (5, 6)").collect()}
    rows = exact_dedup(odd).where("doc_id in (1, 2, 5, 6)").collect()
    assert kept == {(5, False), (6, True), (6, False)} and all(r["keep_id"] == (6 if r["doc_id"] > 2 else 2) for r in rows)
    links = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_set_links"]) for r in jaccard_join(odd).collect()}
    assert links[6] == (5, 2, 0) and links[1] == (1, 0, 0) and links[2] == (2, 0, 0)
    sizes = {r["doc_id"]: (r["size"], r["taken"]) for r in mix(odd, [5, 2, 1]).collect()}
    assert sizes[1] == sizes[2] == sizes[3] == (0, 0) and sizes[4][0] == 40_000
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts(odd, tokenizer_path(), 512).collect()}
    assert counts[1] == counts[2] == (0, 0)
    spans = {r["doc_id"]: r["spans"] for r in secret_digests(scan(odd)).collect()}
    assert set(spans.values()) == {""}


def test_mix_draws_exactly_among_ties(spark):
    """One id held by most rows, null ids, equal sizes, a class drawn whole; targets are met, and reruns agree."""
    rows = [(7, "a b c", "s") for _ in range(400)] + [(None, "a b c", "s") for _ in range(60)] + [(k, "a b c", "s") for k in range(100, 180)] + [(k, "x y z", "t") for k in range(1000, 1700)] + [(k, "p q", "u") for k in range(2000, 2300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    made = mix(docs, [5, 2, 1]).join(spark.createDataFrame([(1620, "s"), (2100, "t"), (600, "u")], "source_size long, source string"), "source_size").toPandas()
    assert len(made) == len(rows)
    for _, g in made.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3, g.target.iloc[0]
    assert (made.taken <= 3 * made["size"]).all()
    key = lambda m: sorted(map(tuple, m[["doc_id", "taken"]].fillna(-1).to_numpy().tolist()))
    again = mix(docs.repartition(3), [5, 2, 1]).toPandas()
    assert key(again) == key(made)


def test_one_labelled_id_on_very_many_documents(spark):
    """An id of many documents is one row of the sample that a model is fitted on."""
    from tessera.llm.toxicity import labelled_sample

    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 900).alias("text"))
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int")
    picked = [labelled_sample(d, labels, "toxic", F.lit(True), 10, "doc_id", "text").collect() for d in (docs, docs.repartition(7))]
    assert len(picked[0]) == 1 and picked[0] == picked[1]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera.llm.common import shared_folder

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: None))
    with pytest.raises(ValueError):
        shared_folder(session)


def test_large_ids_beside_null_ids(spark):
    """Ids that no double holds, with null ids in the same group and in other groups of the same shard."""
    large = [2**53 + 1, 2**60 + 1, 2**60 - 1, -(2**62) - 1]
    rows = [(i, "same", "en", "s", 4) for i in large] + [(None, "same", "en", "s", 4), (None, "alone", "en", "s", 5), (2**53 + 3, "other", "en", "s", 5), (2**53 + 5, "other", "en", "s", 5), (None, "other", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    key = lambda r: str(tuple(r))
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs).collect()), key=key)
    want = [(i, 2**60 + 1, 5, i == 2**60 + 1) for i in [*large, None]] + [(None, None, 1, True)] + [(i, 2**53 + 5, 3, i == 2**53 + 5) for i in (2**53 + 3, 2**53 + 5, None)]
    assert got == sorted(want, key=key)
    stage = dict(pipeline.STAGES)["exact dedup"]
    kept = {(r["doc_id"], r["text"]) for r in stage(spark, docs, None).collect()}
    assert kept == {(2**60 + 1, "same"), (None, "alone"), (2**53 + 5, "other")}


def test_audit_edges(spark):
    schema = "k long, record string, pos long, copy string, digest string"
    rows = [(1, "a", 0, "x", "y"), (1, "a", 0, "x", "y"), (1, "b", 0, "x", "y"), (None, None, 0, "x", "y"), (2, "", 0, "x", "y")]
    base = spark.createDataFrame(rows, schema).drop("pos", "copy", "digest")
    assert audit(base, base, ["k"]).count() == 0
    assert audit(base.limit(0), base, ["k"]).count() == 0
    lost = audit(base, base.limit(0), ["k"])
    assert {r["state"] for r in lost.collect()} == {"missing"} and lost.count() == 5
    changed = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (None, None), (2, "xx"), (9, "new")], "k long, record string")
    assert sorted((r["k"], r["state"]) for r in audit(base, changed, ["k"]).collect()) == [(1, "altered"), (2, "resized")]


def test_audit_reports_what_only_the_replica_has(spark):
    schema = "k long, record string"
    base = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "n")], schema)
    more = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "x"), (9, "new"), (None, "n"), (None, "n")], schema)
    got = audit(base, more, ["k"], added=True).collect()
    assert sorted((r["k"] or 0, r["copy"], r["pos"] is None, r["replica_length"], r["state"]) for r in got) == [(0, 1, True, 1, "added"), (1, 1, True, 1, "added"), (3, 0, False, 1, "altered"), (9, 0, True, 3, "added")]
    assert audit(base, base, ["k"], added=True).count() == 0
    assert [r["state"] for r in audit(base.limit(0), base, ["k"], added=True).collect()] == ["added"] * 5


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, odd, sf_dir, k):
    name, stage = pipeline.STAGES[k]
    kept = stage(spark, odd, sf_dir)
    assert kept.columns == pipeline.COLUMNS
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert (None, "no id") in got and (2**60, "large id") in got and len(got) >= 6
    if k in (1, 2):
        assert sum(t == TEXTS[4][1] for _, t in got) == 1
    assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_the_mixing_stage_on_odd_rows(spark, odd, sf_dir):
    stage = pipeline.STAGES[4][1]
    made = stage(spark, odd, sf_dir)
    assert made.columns == ["doc_id", "size", "source_size", "target", "taken"]
    got = made.collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((i or -1) for i, _ in TEXTS)
    assert all(r["taken"] <= 3 * r["size"] for r in got) and stage(spark, odd.limit(0), sf_dir).count() == 0


def test_pipeline_runs_and_its_decisions_hold(spark, sf_dir):
    made = registry.queries()["pipeline"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id")
    assert made.doc_id.is_unique and not docs.text[made.doc_id].duplicated().any()
    assert 0.5 * len(docs) < len(made) < len(docs)
    toxic = {r["doc_id"] for r in registry.queries()["op8_toxicity"](spark, sf_dir).where("predicted = 1").collect()}
    leaks = {r["doc_id"] for r in registry.queries()["op4_decontamination"](spark, sf_dir).collect()}
    assert not set(made.doc_id) & (toxic | leaks)
    assert len(pipeline.STAGES) == 5
    again = pipeline.run(spark, sf_dir).toPandas()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, made.to_numpy().tolist()))
