"""Duplicates, mixing, archive and packing."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from orelode.llm import archive, line_dedup, minhash_dedup, packing, source_mix, tokens
from orelode.llm import embedding_dedup as e
from orelode.llm.common import connected_components, roots
from orelode.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import connect, same
from .common import awkward, clash, docs, prose


def components(ids, links):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(60)] + [(r.randint(100, 180), r.randint(100, 180)) for _ in range(50)] + [(500, k) for k in range(501, 560)] + [(None, 3), (7, 7)]
    d = spark.createDataFrame(edges, "a long, b long").repartition(6)
    clean = [x for x in edges if None not in x and x[0] != x[1]]
    want = components({v for x in clean for v in x}, clean)
    assert {r.node: r.component for r in connected_components(d).collect()} == want
    nodes, low = roots(np.array([5, 1, 9]), np.array([1, 2, 8]))
    assert dict(zip(nodes.tolist(), low.tolist())) == {1: 1, 2: 1, 5: 1, 8: 8, 9: 8}


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (400, 32))
    for k in range(120):
        x[k] = x[k % 6] + r.normal(0, 0.05 if k % 2 else 0.3, 32)
    x[200] = x[201]
    odd = [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, []), (904, [1.0] * 16), (905, [1.0] * 16), (906, [1.0, None] * 16), (None, [1.0] * 16)]
    data = [(k, v.tolist()) for k, v in enumerate(x)] + odd + [(0, x[0].tolist())]
    df = clash(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5), "id", "n_links")
    got = e.near_vectors(df)
    rows = got.collect()
    assert len(rows) == len(data)
    u = np.vstack([x, x[:1]]) / np.linalg.norm(np.vstack([x, x[:1]]), axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    ids = [*range(400), 0]
    want = {}
    for k, i in enumerate(ids):
        want[i] = int(link[k].sum())
    comp = components(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link), strict=True) if ids[a] != ids[b]])
    for row in rows:
        if row.vec_id is not None and row.vec_id < 900:
            assert (row.n_links, row.component_id, row.kept) == (want[row.vec_id], comp[row.vec_id], comp[row.vec_id] == row.vec_id)
        elif row.vec_id in (904, 905):
            assert row.component_id == 904 and row.n_links == 1
        else:
            assert row.n_links == 0 and row.component_id == row.vec_id and row.kept
    assert e.near_vectors(df.limit(0)).count() == 0


def test_an_id_with_two_vectors_links_by_both(spark):
    r = np.random.default_rng(8)
    a, b, c = r.normal(0, 1, (3, 16))
    data = [(1, a), (1, b), (2, a * 2 + 0.01), (3, b * 3 - 0.01), (4, c), (5, -0.0 * c), (6, a), (1, a)]
    got = e.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in data], "vec_id long, embedding array<double>").repartition(3)).collect()
    rows = sorted((x.vec_id, x.n_links, x.component_id, x.kept) for x in got)
    assert rows == [(1, 1, 1, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 3, 1, False)]


def test_hot_embedding_group_is_split(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    monkeypatch.setattr(e, "HOT", 32)
    r = np.random.default_rng(6)
    base = r.normal(0, 1, 24)
    x = np.vstack([base + r.normal(0, 0.02, (100, 24)), r.normal(0, 1, (60, 24))])
    got = {q.vec_id: q for q in e.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert all(got[k].n_links == 99 and got[k].component_id == 0 for k in range(100))


def test_estimates_are_unbiased():
    r = np.random.default_rng(7)
    errors = []
    for _ in range(300):
        o, q = r.normal(0, 1, 32), r.normal(0, 1, 32)
        q = 0.8 * o / np.linalg.norm(o) + 0.6 * (q - (q @ o) * o / (o @ o)) / np.linalg.norm(q - (q @ o) * o / (o @ o))
        o = o / np.linalg.norm(o)
        p = np.vstack([np.linalg.qr(r.standard_normal((32, 32)))[0].T for _ in range(4)])
        y = p @ o
        errors.append(np.sign(y) @ (p @ q) / np.abs(y).sum() - o @ q)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.08


def plain_sets(data, width=5):
    out = {}
    for i, t, *_ in data:
        w = minhash_dedup.lower_ascii(t or "").split()
        out[i] = {b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def near_copies(n=60, seed=3):
    r, data = random.Random(seed), []
    for k, t in enumerate(prose(n, seed, 3000, (40, 150))):
        data.append((10 * k, t, "en", "a", 1))
        for c in range(1, r.randint(1, 5)):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "edited"
            data.append((10 * k + c, " ".join(w) if c % 2 else " ".join(w).upper(), "en", "b", 1))
    return data


def check_documents(spark, data, percent=85):
    sets = plain_sets([d for d in data if d[0] is not None])
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = minhash_dedup.near_documents(clash(docs(spark, data), "component_id", "id"), percent).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept


def test_near_documents_equal_brute_force(spark):
    check_documents(spark, near_copies() + [(100_000 + (d[0] or 0), *d[1:]) if d[0] is not None else d for d in awkward()])


def test_dense_region(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "REGION", 8)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    r, base, data = random.Random(4), prose(1, 5, 3000, (200, 200))[0].split(), []
    for k in range(90):
        w = list(base)
        w[r.randrange(len(w))] = f"x{k}"
        data.append((k, " ".join(w), "en", "a", 1))
    check_documents(spark, data + [(1000 + k, t, "en", "a", 1) for k, t in enumerate(prose(40, 6))])


def test_dense_family_that_is_not_one_component(spark, monkeypatch):
    """A family of loosely alike texts, groups of near copies in it, and everything crowded and large."""
    for name, n in (("REGION", 6), ("BLOCK", 8)):
        monkeypatch.setattr(minhash_dedup, name, n)
    r, base, data = random.Random(14), prose(1, 15, 3000, (160, 160))[0].split(), []
    for g in range(12):
        own = list(base)
        for at in r.sample(range(0, 160, 8), 6):
            own[at] = f"g{g}"
        for c in range(6):
            w = list(own)
            w[r.randrange(160)] = f"c{g}x{c}"
            data.append((100 * g + c, " ".join(w), "en", "a", 1))
    check_documents(spark, data)
    check_documents(spark, data, 80)


def test_recall_in_crowded_regions_at_the_threshold(spark, monkeypatch):
    """Pairs just over the threshold, all in one crowded family: at least 0.99 are found."""
    monkeypatch.setattr(minhash_dedup, "REGION", 16)
    r, base, data = random.Random(16), prose(1, 17, 5000, (400, 400))[0].split(), []
    for g in range(120):
        own = list(base)
        for at in r.sample(range(0, 400, 10), 12):  # families differ in 60 and more of about 400 shingles
            own[at] = f"g{g}"
        other = list(own)
        for at in r.sample([k for k in range(5, 400, 10)], 5):
            other[at] = f"h{g}"
        data += [(10 * g, " ".join(own), "en", "a", 1), (10 * g + 1, " ".join(other), "en", "a", 1)]
    for percent in (80, 85):
        sets = plain_sets(data)
        links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        got = {x.doc_id: x.component_id for x in minhash_dedup.near_documents(docs(spark, data), percent).collect()}
        assert len(links) >= 100 and np.mean([got[a] == got[b] for a, b in links]) >= 0.99


def test_an_id_with_two_texts_links_with_what_either_links_with(spark):
    a, b = prose(2, 21, 3000, (60, 60))
    data = [(1, a, "en", "a", 1), (1, b, "en", "a", 1), (2, a + " end", "en", "a", 1), (3, b + " end", "en", "a", 1), (0, "other words stand here now", "en", "a", 1)]
    got = {x.doc_id: x.component_id for x in minhash_dedup.near_documents(docs(spark, data)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}


def test_crowded_regions_lose_no_pairs(spark, monkeypatch):
    r, data = random.Random(9), []
    for k, t in enumerate(prose(80, 11, 3000, (120, 120))):
        w = t.split()
        data.append((2 * k, t, "en", "a", 1))
        for at in r.sample(range(0, 120, 6), 5):
            w[at] = f"x{k}"
        data.append((2 * k + 1, " ".join(w), "en", "a", 1))
    run = lambda: {x.doc_id: x.component_id for x in minhash_dedup.near_documents(docs(spark, data), 60).collect()}
    want = run()
    monkeypatch.setattr(minhash_dedup, "REGION", 1)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 1)
    assert sum(i != c for i, c in want.items()) > 40 and run() == want


def test_no_documents(spark):
    assert minhash_dedup.near_documents(docs(spark, [])).count() == 0


def test_line_dedup_equals_brute_force(spark):
    r, data = random.Random(5), []
    pool = prose(25, 7, 60, (1, 20)) + prose(3, 8, 900, (150, 250)) + ["", " \t "]
    for k in range(40):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = r.choice(pool).split(" ")
            if r.random() < 0.4:
                w[r.randrange(len(w))] = f"n{r.randint(0, 3)}"
            lines.append(" ".join(w) if r.random() < 0.8 else " ".join(w).upper())
        data.append((k, "\n".join(lines), "en", "a", 1))
    seen, want = [], {}
    for k, t, *_ in data:
        stay = []
        for x in t.split("\n"):
            s = set(x.lower().split())
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                pass
            else:
                stay.append(x)
            if s:
                seen.append(s)
        want[k] = "\n".join(stay)
    got = line_dedup.dedup_lines(clash(docs(spark, data), "line", "n_removed")).collect()
    assert {x.doc_id: x.text for x in got} == want


def test_line_dedup_edges(spark):
    got = line_dedup.dedup_lines(docs(spark, awkward())).collect()
    assert len(got) == len(awkward())
    by = {x.doc_id: x for x in got}
    assert by[2].text is None and by[3].text == "" and by[5].n_removed == 0 and by[6].text == "" and by[None].n_removed == 0
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    # Texts that share an id are documents of their own: only the line that matches another goes.
    two = [(1, "red fish\nblue fish", "en", "a", 1), (1, "blue fish\ngreen fish", "en", "a", 1), (0, "Red  fish", "en", "a", 1)]
    left = sorted(x.text for x in line_dedup.dedup_lines(docs(spark, two)).collect())
    assert left in (["Red  fish", "blue fish", "green fish"], ["Red  fish", "blue fish\ngreen fish", ""], ["", "Red  fish", "blue fish\ngreen fish"])


def test_hot_words_and_groups_of_line_copies(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LIST_ROWS", 20)
    r, words = random.Random(8), prose(1, 3, 4000, (40, 40))[0].split()
    rows = [(k, " ".join([*words[: k % 40], f"n{r.randint(0, 9)}", *words[k % 40 + 1 :]]), "en", "a", 1) for k in range(300)] + [(1000 + k, f"page {k}", "en", "a", 1) for k in range(200)]
    left = {x.doc_id for x in line_dedup.dedup_lines(docs(spark, rows)).where("n_removed = 0").collect()}
    assert left == {0, *range(1000, 1200)}


def test_lines_are_split_once_and_only_common_words_meet_first(spark, monkeypatch):
    rows = [(k, " ".join(f"w{j}" for j in range(30) if j != k), "en", "a", 1) for k in range(20)]
    lines = line_dedup.line_words(line_dedup._keyed(docs(spark, rows)))
    levels, counts = line_dedup.rarity_levels(lines)
    classes = line_dedup.line_classes(lines, levels, 80)
    first = lambda: {x.d1: x.d2 for x in line_dedup.earliest_partners(classes, 80, counts).collect()}
    # No word is in more than SHORT_LIST lines: all pairs are left to the join.
    found = first()
    assert found == {}
    nothing = spark.createDataFrame([], "d1 long, t1 long, l1 int")
    assert {(x.d1, x.d2) for x in line_dedup.other_partners(classes, nothing, 80).collect()} == {(a, b) for a in range(20) for b in range(a)}
    monkeypatch.setattr(line_dedup, "SHORT_LIST", 10)
    found = first()
    assert set(found) == set(range(1, 20)) and all(b < a for a, b in found.items())


def test_parity_of_short_and_long_lines_rules_out_no_similar_pair(spark):
    """Lines on either side of 64 words: one with both halves of its parity laid upon each other, one with two halves."""
    rows = [(k, " ".join([*(f"w{k // 2}x{j}" for j in range(60 + k % 2 * (3 + k // 2 % 12)))]), "en", "a", 1) for k in range(0, 60)]
    got = {x.doc_id for x in line_dedup.dedup_lines(docs(spark, rows)).where("n_removed = 1").collect()}
    assert got == {k for k in range(60) if k % 2}


def test_mix_laws(spark):
    data = [(k, t, "en", None if k % 7 == 0 else f"s{k % 3}", 1) for k, t in enumerate(prose(300, 8, length=(0, 60)))]
    d = clash(docs(spark, data), "size", "target", "copies")
    out = source_mix.mix_sources(d).cache()
    again = source_mix.mix_sources(d.repartition(7))
    key = lambda x: sorted(map(str, x.select("doc_id", "taken").collect()))
    assert key(out) == key(again)
    total = sum(len(t.split()) for _, t, *_ in data)
    per = out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.first("source_size").alias("s"), F.max("size").alias("m")).collect()
    assert abs(sum(p.t for p in per) - 1.5 * total) < 1e-6
    assert all(abs(p.k - p.t) <= p.m and p.t <= 2 * p.s for p in per)
    assert out.where("taken > 2 * size").count() == 0
    # Complete epochs first: a source above its size takes every document with words.
    assert out.where("target >= source_size and size > 0 and taken < size").count() == 0
    assert source_mix.mix_sources(docs(spark, awkward())).count() == len(awkward())
    assert source_mix.mix_sources(docs(spark, [])).count() == 0


def test_mix_prefers_quality(spark):
    data = [(k, "a b c d e", "en", f"s{k % 2}", k % 4) for k in range(4000)]
    w = F.when(F.col("doc_id") % 4 < 2, F.lit(4.0)).otherwise(F.lit(1.0))
    out = source_mix.mix_sources(docs(spark, data), weights=(1,), share_percent=50, quality=w)
    n = {r[0]: r[1] for r in out.where("taken > 0").groupBy(F.col("doc_id") % 4 < 2).count().collect()}
    assert n[True] > 1.4 * n[False]


PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    big, tricky = "x" * 1500, "é" * 600 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", tricky), (5, "u", tricky), (6, "u", "small"), (7, "u", "small"), (8, "u", None), (9, "u", ""), (3, None, big), (None, "u", big)]
    pages = clash(spark.createDataFrame(rows, PAGES).repartition(4), "sha256", "ord")
    got = archive.round_trip(pages, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes))
    assert by[1] == [("revisit", 3, 1500)] and sorted(by[3]) == [("response", None, 1500), ("revisit", 3, 1500)] and by[None] == [("revisit", 3, 1500)]
    assert by[5] == [("response", None, len(tricky.encode()))] and by[4][0][:2] == ("revisit", 5)
    assert {x[0] for k in (6, 7, 8, 9) for x in by[k]} == {"response"}
    # The store holds each payload once, and header + payload are the records again.
    store = str(tmp_path / "a/store")
    assert spark.read.parquet(store + "/payloads").count() == 4
    full = {(r.page_id, r.ord): r.record for r in archive.restore(spark, store).collect()}
    assert full[5, 0].endswith("\r\n\r\n" + tricky) and len(full) == len(rows)
    assert archive.round_trip(pages.limit(0), str(tmp_path / "b")).count() == 0


def test_packing_round_trip(spark):
    data = awkward() + [(999, "a\x7fb \x01 c\x1cd \u0558", "en", "a", 1)] + [(1000 + k, t, "en", "a", 1) for k, t in enumerate(prose(80, 2, length=(1, 900)))]
    out = packing.pack_documents(clash(docs(spark, data), "piece", "length")).toPandas()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    q = out.sort_values(["sequence_id", "offset"])
    end = q["offset"] + q["length"]
    assert (q["offset"] == end.groupby(q["sequence_id"]).shift(1).fillna(0)).all() and end.max() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 2
    for i, text, *_ in data:
        if i is None or i == 7:
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        own = out[out["doc_id"] == i].sort_values("piece")
        assert list(own["start"]) == list(range(0, len(ids) // 4, 2048)) and own["length"].sum() == len(ids) // 4
        assert [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(own["start"], own["length"], strict=True)] == list(own["ids_crc32"])
    assert len(out[out["doc_id"] == 7]) == 2
    assert packing.pack_documents(docs(spark, [])).count() == 0
    seqs = packing.sequences(docs(spark, data[:6])).collect()
    assert all(len(s.ids) <= 2048 for s in seqs)


def test_fullest_is_optimal():
    r = random.Random(6)
    for _ in range(200):
        counts = np.zeros(31, np.int64)
        for _ in range(r.randint(1, 7)):
            counts[r.randint(1, 30)] += 1
        seed = int(np.flatnonzero(counts)[-1])
        combo = packing.fullest(seed, counts, 30)
        items = [n for n in range(31) for _ in range(counts[n])]
        items.remove(seed)
        best = max(s for m in range(1 << len(items)) if (s := seed + sum(x for k, x in enumerate(items) if m >> k & 1)) <= 30)
        assert sum(n * k for n, k in combo) == best
        assert all(k <= counts[n] for n, k in combo)


def test_queries_equal_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLE_SQL.items():
        same(QUERIES[name](spark, sf_dir), con, sql)


def test_line_dedup_returns_the_callers_columns(spark):
    from orelode.llm import line_dedup

    names = ["_key", "_id", "_gone", "_all", "_stay", "word", "n_lines"]
    rows = clash(docs(spark, [(1, "one fish\ntwo fish", "en", "x", 17), (2, "two fish\nred fish", "en", "x", 17), (3, None, "en", "x", 0)]), *names)
    got = line_dedup.dedup_lines(rows).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == {1: ("one fish\ntwo fish", 2, 0), 2: ("red fish", 2, 1), 3: (None, 0, 0)}
    assert all(r[n] == "clash" for r in got for n in names[:-1])


def test_region_joins_have_one_row_a_document(spark, monkeypatch):
    """A document that lies in a region of each tree enters joins on id once, not once a region."""
    rows = [(k, " ".join(f"w{(k % 3) * 1000 + j}" for j in range(80)) + f" x{k}", "en", "a", 1) for k in range(30)]
    seen, whole = [], minhash_dedup.region_pairs
    monkeypatch.setattr(minhash_dedup, "region_pairs", lambda own, *a: seen.append((own.count(), own.select("id").distinct().count())) or whole(own, *a))
    got = minhash_dedup.near_documents(docs(spark, rows))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(k, k % 3) for k in range(30)}
    assert seen and all(n == ids for n, ids in seen)
