import hashlib
import os
import struct
from collections import Counter, defaultdict

import pytest
from helpers import DOCS
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from skelmap.llm import exact_dedup, mixing, quality, queries, simhash, sql

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_ann_forest": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op7_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op8_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10_sentencepiece": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op11_importance": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op12_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op13_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
}


@pytest.fixture(scope="module")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 14)] and "pipeline" in names
    assert set(sql.oracle_sql()) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    kinds = dict(queries.queries()[name](spark, sf).dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]


@pytest.mark.parametrize("name", sql.oracle_sql())
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(sql.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_whole_tables_are_covered(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_language_id", "op3_simhash", "op6_quality", "op9_mixing", "op10_sentencepiece"):
        assert queries.queries()[name](spark, sf).count() == n, name


def test_op3_against_all_pairs(spark, sf):
    from test_dedup import brute_groups, brute_simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_simhash(r.text) for r in docs]
    group = brute_groups(fps)
    least = {}
    for r, g in zip(docs, group):
        least.setdefault(g, r.doc_id)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op3_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{f:016x}", least[g]) for r, f, g in zip(docs, fps, group)}


def test_op5_recall(spark, sf):
    from test_search_and_scan import brute_nearest, found, recall

    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute_nearest(table), found(queries.op5_ann_forest(spark, sf))
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_op2_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = queries.op2_language_id(spark, sf).where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first()
    assert r.x > 0.9


# --- the pipeline --------------------------------------------------------------------------------------------------------


def test_stages_against_brute_force(spark, sf, tmp_path):
    from test_dedup import brute_groups, brute_simhash, shingles

    read = lambda df, n: (df.write.parquet(f"{tmp_path}/{n}"), spark.read.parquet(f"{tmp_path}/{n}"))[1]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    good = read(steps["quality classifier"](spark, docs, sf), 1)
    model = queries.quality_model(spark, sf)
    kept = {r.doc_id for r in quality.score(docs, model, keep_above=queries.KEEP_ABOVE).where("kept").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept

    single = read(steps["exact dedup"](spark, good, sf), 2)
    last = {}
    for r in good.orderBy("doc_id").collect():
        last[r.text or ""] = r.doc_id
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(last.values())

    apart = read(steps["simhash near-dedup"](spark, single, sf), 3)
    table = single.orderBy("doc_id").collect()
    left = {r.doc_id for r in apart.collect()}
    group = brute_groups([brute_simhash(r.text, 5) for r in table])
    sets = [shingles(r.text) for r in table]
    gone = {r.doc_id for r in table} - left
    for i, r in enumerate(table):
        near = [j for j in range(len(table)) if j != i and (group[i] == group[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.7)]
        sure = [j for j in near if group[i] == group[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.9]
        assert near or r.doc_id in left
        assert not any(table[j].doc_id in left and table[j].doc_id != r.doc_id and r.doc_id in left for j in sure)
    assert apart.columns == columns and len(gone) == len(table) - len(left)

    mixed = steps["mixing sources"](spark, apart, sf)
    order = [r.doc_id for r in mixed.collect()]
    slots = {r.doc_id: (r.mix_slot, r.mix_at) for r in mixing.mix(apart, queries.MIX_WEIGHTS).collect()}
    assert mixed.columns == columns and order == sorted(left, key=slots.get)

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, list(r.ids)) for r in steps["sentencepiece"](spark, mixed, sf).collect()}
    for r in apart.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert coded.pop(r.doc_id) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), ids)
    assert not coded


def test_run_is_its_stages(spark, sf):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert got == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_run_keeps_the_schedule(spark, sf):
    """The mixing stage writes several files; the last stage restores their order."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = corpus_pipeline.run(spark, sf).collect()
    finally:
        spark.conf.set(name, old)
    kept = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id").isin([r.doc_id for r in got]))
    slots = {r.doc_id: (r.mix_slot, r.mix_at) for r in mixing.mix(kept, queries.MIX_WEIGHTS).collect()}
    assert [r.doc_id for r in got] == sorted(slots, key=slots.get)
    assert all((r.mix_slot, r.mix_at) == slots[r.doc_id] for r in got)


def test_clean_documents_stay_and_toxic_ones_go(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = quality.keep_good(spark.read.parquet(f"{sf}/documents.parquet"), queries.quality_model(spark, sf), keep_above=queries.KEEP_ABOVE).select("doc_id")
    n = Counter()
    stays = {r.doc_id for r in kept.collect()}
    for r in quality.grades_of(labels).collect():
        n[r.grade, r.doc_id in stays] += 1
    assert n[2, True] > 0.95 * (n[2, True] + n[2, False]) and n[0, True] == 0


def test_stages_bear_awkward_rows(spark, sf):
    from helpers import AWKWARD, clashing

    docs = clashing(spark.createDataFrame(AWKWARD, DOCS))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, sf)
            assert name == "sentencepiece" or out.columns == docs.columns, name
            assert out.count() <= table.count(), name


def test_kept_copy_has_the_largest_id(spark):
    df = spark.createDataFrame([(1, "a"), (9, "a"), (4, "a"), (2, None), (3, ""), (9, "b"), (9, "b")], "doc_id long, text string")
    got = defaultdict(list)
    for r in exact_dedup.drop_copies(df).collect():
        got[r.text or ""].append(r.doc_id)
    assert got == {"a": [9], "": [3], "b": [9]}


def test_near_copy_that_stays_has_the_smallest_id(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(7, text), (3, text + " end"), (5, text.replace("w100 ", "x ")), (1, "another text altogether")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(df).collect()) == [1, 3]
