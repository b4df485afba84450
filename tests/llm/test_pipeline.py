"""The corpus pipeline, stage by stage, against plain versions."""

from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from flowlens.llm import quality, secrets
from flowlens.llm.queries import tokenizer_file
from tests.conftest import SF
from tests.llm import brute

COPY = "a good long line about the things that are said here again and again by all of the people who came "


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest documents and labels, with copies, near copies, secrets, nulls and clashing columns."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kind = dict(docs.dtypes)["doc_id"]
    n_kind = dict(docs.dtypes)["n_chars"]
    base = docs.where("length(text) > 400").orderBy("doc_id").limit(3).collect()
    made = [(900_000 + i, base[i % 2].text) for i in range(4)]  # exact copies
    made += [(910_000 + i, base[2].text + f" ending{i}") for i in range(5)]  # near copies
    made += [(920_000, 'only here the line says password = "hunter22kk" and nothing else at all'), (920_001, None), (920_002, ""), (None, "without an id")]
    made += [(None, "without an id"), (920_003, "twice"), (920_003, "twice")]
    more = spark.createDataFrame(
        [(i, t, "en", "src1", len(t or "")) for i, t in made], f"doc_id {kind}, text string, lang string, source string, n_chars {n_kind}"
    )
    names = ("__id", "__nth", "__key", "__sha", "__doc", "__cut", "kept", "uid", "label", "n", "digest", "spans")
    both = docs.select(more.columns).unionByName(more)
    both = both.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in names})
    both.coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near duplicates", "secret scans", "best-fit packing"]

    good = stages["quality classifier"](spark, docs, tables).cache()
    scored = quality.quality(docs, labels).collect()
    assert good.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in good.collect()))) == sorted(str(r.doc_id) for r in scored if r.predicted == 1)
    assert 0 < good.count() < docs.count()

    whole = docs.cache()  # the later stages see every kind of row
    single = stages["exact dedup"](spark, whole, tables).cache()
    largest = defaultdict(lambda: -1)
    for r in whole.collect():
        largest[r.text or ""] = max(largest[r.text or ""], -1 if r.doc_id is None else r.doc_id)
    want = {t: i for t, i in largest.items()}
    assert {(r.text or ""): -1 if r.doc_id is None else r.doc_id for r in single.collect()} == want
    assert single.count() == len(want) and single.columns == docs.columns

    apart = stages["near duplicates"](spark, single, tables).cache()
    known = [(r.doc_id, r.text) for r in single.collect() if r.doc_id is not None]
    stay = {i for i, (_, c) in brute.components(known).items() if c == i}
    assert {r.doc_id for r in apart.collect() if r.doc_id is not None} == stay and len(stay) < len(known)
    assert sum(r.doc_id is None for r in apart.collect()) == sum(r.doc_id is None for r in single.collect())

    masked = stages["secret scans"](spark, apart, tables).cache()
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.live] for r in secrets.scan(apart).collect()}
    assert masked.columns == docs.columns and masked.count() == apart.count()
    before = {r.doc_id: r for r in apart.collect()}
    for r in masked.collect():
        old = before[r.doc_id]
        if spans[r.doc_id]:
            assert r.text == secrets._mask(old.text, spans[r.doc_id]) != old.text and r.n_chars == len(r.text)
        else:
            assert r == old
    assert any(spans.values())

    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json")).encode
    packed = defaultdict(list)
    for r in stages["best-fit packing"](spark, masked, tables).collect():
        packed[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for r in masked.collect():
        assert sorted(packed[r.doc_id]) == brute.token_pieces(encode(r.text or "", add_special_tokens=False).ids + [2])


def test_run_passes_on_what_each_stage_kept(spark, tables):
    packed = corpus_pipeline.run(spark, tables)
    kept = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, tables).cache()
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}


def test_empty_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0, name


def test_labels_of_repeated_documents_stay_bounded(spark):
    """A labelled text that is repeated a thousand times is one training row."""
    docs = spark.createDataFrame([(1, "good words here")] * 1000 + [(2, "bad"), (3, "x y z")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (None, 1), (1, None)], "doc_id long, quality int")
    seen = []
    old = quality.fit_trees
    quality.fit_trees = lambda x, y: seen.append(len(y)) or old(x, y)
    try:
        quality.fit(docs, labels)
    finally:
        quality.fit_trees = old
    assert seen and seen[0] <= 3
