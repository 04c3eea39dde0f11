import corpus_pipeline as p
from orelode.llm import common, source_mix

from .common import awkward, clash, prose
from .common import docs as table
from .test_sets import plain_sets


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        seen[name] = docs.count()
    assert 0 < seen["near_dedup"] <= seen["line_dedup"] <= seen["toxicity"] < 200 and seen["mixing"] > 0
    out = p.STAGES[-1][1](spark, docs, sf_dir)
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_near_dedup_leaves_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = p.near_dedup(spark, docs, sf_dir).select("doc_id", "text").collect()
    sets = plain_sets(left)
    ids = sorted(sets)
    assert not [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    # What goes is like something that stays or goes: every text that is alone is still there.
    every = plain_sets(docs.select("doc_id", "text").collect())
    alone = {a for a in every if not any(a != b and every[a] and every[b] and 100 * len(every[a] & every[b]) >= 80 * len(every[a] | every[b]) for b in every)}
    assert alone <= set(ids)


def test_near_dedup_tells_rows_apart(spark, sf_dir):
    a, b = prose(2, 31, 2000, (60, 60))
    rows = [(5, a, "en", "x", 1), (5, a, "en", "x", 1), (5, b, "en", "x", 1), (3, b + " end", "en", "x", 1), (None, a, "en", "x", 1), (9, None, "en", "x", 1), (9, " ", "en", "x", 1)]
    left = sorted(((r.doc_id or 0), r.text or "") for r in p.near_dedup(spark, table(spark, rows), sf_dir).collect())
    assert left == [(3, b + " end"), (5, a), (9, ""), (9, " ")]
    assert p.near_dedup(spark, table(spark, []), sf_dir).count() == 0


def test_line_dedup_stage(spark, sf_dir):
    rows = [(1, "one fish\ntwo fish", "en", "x", 17), (2, "Two  fish\nred fish", "en", "x", 18), (3, "red fish", "en", "x", 8), (4, None, "en", "x", None), (None, "one fish", "en", "x", 8), (5, "", "en", "x", 0)]
    got = {r.doc_id: (r.text, r.n_chars) for r in p.line_dedup(spark, table(spark, rows), sf_dir).collect()}
    assert got == {1: ("one fish\ntwo fish", 17), 2: ("red fish", 8), 4: (None, None), None: ("one fish", 8), 5: ("", 0)}


def test_mixing_takes_rows_without_id_and_repeated_rows(spark, sf_dir):
    docs = table(spark, awkward())
    want = {r[0]: r[1] for r in source_mix.mix_sources(docs).groupBy("doc_id").agg({"copies": "sum"}).collect()}
    got = {r[0]: r[1] for r in p.mixing(spark, docs, sf_dir).groupBy("doc_id").count().collect()}
    assert want[None] > 0 and want[7] > 2
    assert got == {k: n for k, n in want.items() if n}


def test_awkward_rows_in_every_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    shifted = [(None if d[0] is None else 1_000_000 + d[0], *d[1:]) for d in awkward()]
    docs = p.materialise(docs.unionByName(spark.createDataFrame(shifted, docs.schema)), "awkward")
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, sf_dir), name)
        n = docs.where("doc_id is null").count()
        assert n == 1 if name != "mixing" else 0 < n <= 2
    assert p.STAGES[-1][1](spark, docs, sf_dir).where("doc_id is null").count() > 0


def test_results_of_two_calls_can_both_be_read_later(spark, sf_dir):
    one = p.line_dedup(spark, table(spark, [(1, "one fish\ntwo fish", "en", "x", 17), (2, "two fish\nred fish", "en", "x", 17)]), sf_dir)
    two = dict(p.STAGES)["line_dedup"](spark, table(spark, [(1, "blue fish", "en", "x", 9)]), sf_dir)
    dict(p.STAGES)["near_dedup"](spark, table(spark, [(1, "blue fish", "en", "x", 9)]), sf_dir).count()
    assert one.count() == 2 and two.count() == 1


def test_columns_of_the_caller_come_back_unchanged(spark, sf_dir):
    names = ["margin", "grade", "toxic", "kept", "copies", "_row", "_key", "_id", "_gone", "_all", "_stay", "word", "component_id"]
    rows = table(spark, [(k, f"{t}\nline {k} of its own here", "en", "x", 9) for k, t in enumerate(prose(12, 5, 3000, (40, 60)))])
    docs = p.materialise(clash(rows, *names), "clash")
    for name, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*rows.columns, *names] and docs.count() > 0
        assert {tuple(r) for r in docs.select(*names).distinct().collect()} == {("clash",) * len(names)}


def test_run_leaves_only_what_it_still_reads(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_dir", lambda spark: f"file://{tmp_path}")
    out = p.run(spark, sf_dir)
    assert out.count() > 0
    left = [x.name for x in tmp_path.iterdir()]
    assert [x.split("-")[1] for x in left if x.startswith("pipeline-")] == ["mixing"]
    assert not [x for x in left if x.startswith(("numbered", "toxicity"))]
