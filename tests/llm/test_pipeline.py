"""The pipeline's stages, each on the rows that the last one left."""

import re

import corpus_pipeline
from loomstone.llm import decontam, minhash, sstable
from test_wide import components_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.fresh_path(spark, f"test-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == COLUMNS
        sizes[name] = docs.count()
        if name == "near_duplicates":
            assert minhash.components(docs).where("not kept").count() == 0
        if name == "decontaminate":
            benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontam.verdicts(docs, benchmark).where("n_hit > 0").count() == 0
    assert 0.95 * before <= sizes["language"] <= before
    assert sizes["near_duplicates"] < sizes["language"]
    assert sizes["decontaminate"] <= sizes["near_duplicates"]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert rows.count() == sizes["mix_sources"]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, sstable.token_rows(docs).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, rows.collect()))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def by_hand(rows):
    """The rows that near_duplicates keeps, by comparing all pairs of texts."""
    components = [c[2] for c in components_by_hand([(i, r[1]) for i, r in enumerate(rows)])]
    groups = {}
    for r, c in zip(rows, components, strict=True):
        groups.setdefault(c, []).append(r)
    return groups


def test_near_duplicates_keeps_one_row_of_each_component(spark, docs, rows, sf_dir):
    text = "one two three four five six seven eight nine ten eleven twelve"
    more = [(7, text + " thirteen", "en", "web"), (7, "quite another text that shares nothing at all with it", "en", "web"), (8, text + " fourteen", "en", "web"),
            (None, "no id here but words enough to be a text", None, None), (None, "no id here but words enough to be a text", None, None),
            (9, "the same row twice is one row in the end", "en", "a"), (9, "the same row twice is one row in the end", "en", "b")]
    more = [(*m, None, None, None, None, None, None) for m in more]
    every = [*rows, *more]
    table = spark.createDataFrame(every, docs.schema).repartition(3)
    got = [tuple(r) for r in stage("near_duplicates")(spark, table, sf_dir).collect()]
    groups = by_hand(every)
    kept = {}
    for row in got:
        owner = [c for c, members in groups.items() if row in members]
        assert len(owner) >= 1
        kept.setdefault(owner[0], []).append(row)
    for c, members in groups.items():
        if not re.search(r"[^\x20\x09-\x0D]", members[0][1] or ""):
            continue
        ids = [m[0] for m in members if m[0] is not None]
        assert [r[0] for r in kept[c]] == [min(ids) if ids else None], members
        assert kept[c][0][3] == min((m[3] for m in members if m[:2] == kept[c][0][:2]), key=lambda s: s or "")
    wordless = [r for r in every if not re.search(r"[^\x20\x09-\x0D]", r[1] or "")]
    assert len(got) == len(wordless) + sum(bool(re.search(r"[^\x20\x09-\x0D]", m[0][1] or "")) for m in groups.values())


def test_decontaminate_drops_short_passages_in_long_texts(spark, docs, rows, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first()["text"]
    window = " ".join(re.findall(r"\w+", item)[:13])
    planted = [(1, " ".join(f"w{i}" for i in range(3000)) + " " + window.upper() + " the end", None, None), (2, "clean text of no interest", None, None), (3, None, None, None)]
    table = spark.createDataFrame(planted, "doc_id long, text string, lang string, source string")
    assert sorted(r[0] for r in stage("decontaminate")(spark, table, sf_dir).collect()) == [2, 3]


def test_stages_with_odd_rows(spark, docs, rows, sf_dir):
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = corpus_pipeline.fresh_path(spark, f"odd-{name}")
        step(spark, kept, sf_dir).write.parquet(path)
        after = spark.read.schema(docs.schema).parquet(path)
        assert after.columns == docs.columns
        assert after.distinct().exceptAll(kept.distinct()).count() == 0, "a stage makes no rows of its own"
        if name == "language":
            left = {r["text"] for r in after.collect()}
            assert None not in left and not any(re.fullmatch(r"[\W\d_]*", t) for t in left)
        kept = after


def test_stages_without_rows(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
