"""Lexical index, ranked search, decontamination and the filter audit against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from orelode.llm import decontamination as dc
from orelode.llm import filter_audit as fa
from orelode.llm import lexical_index as li
from orelode.llm import lexical_search as ls

from .common import awkward, clash, docs, prose

ITEMS = "item_id long, text string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low)


def corpus(seed=3):
    """Prose with copies, ties, frequent and rare words, and passages of items."""
    r = random.Random(seed)
    texts = prose(150, seed, words=90, length=(1, 70))
    items = [" ".join(r.choices([f"w{k}" for k in range(90)], k=n)) for n in (1, 3, 9, 10, 12, 25, 40)]
    texts += [f"Before, {t.upper()}! {t}" for t in items] + [f"{t[: len(t) // 2]} gap {t[len(t) // 2 :]}" for t in items]
    texts += [" ".join(reversed(items[4].split())), " ".join(r.sample(items[3].split(), 10))] + [texts[5]] * 40
    rows = [(100 + k, t, "en", "a", len(t)) for k, t in enumerate(texts)] + awkward()
    r.shuffle(rows)
    return rows, [(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (92, "nowhere"), (93, items[5]), (93, items[5])]


def slow_search(rows, items, k):
    tf = [(d[0], Counter(terms(d[1]))) for d in rows]
    tf = [x for x in tf if x[1]]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in tf:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None or d == None, d or 0, d))  # noqa: E711
        out += [(str(item), rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "chunk", "short", "k"), [(li.BLOCK, li.CHUNK, ls.SHORT, 20), (60, 30, 0.2, 5), (400, 1000, 0.0, 3), (400, 1000, 1.0, 3)])
def test_search_equals_scoring_every_document(spark, monkeypatch, block, chunk, short, k):
    """Small blocks and chunks, all lists short or all long: the same rows."""
    rows, items = corpus()
    monkeypatch.setattr(li.chunks, "__defaults__", (chunk,))
    index = li.build_index(clash(docs(spark, rows), "term", "block", "ord", "gaps"), block)
    got = ls.search(index, clash(docs(spark, items, ITEMS), "item", "terms", "rank", "score", "doc_id"), k, short)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()), key=str) == slow_search(rows, items, k)


def test_walk_with_many_documents_skips_and_stays_exact():
    """Ranges of documents, rising thresholds and bounds, against full sums."""
    r = np.random.default_rng(5)
    n = 3 * ls.RANGE + 17
    block = type("B", (), {"words": np.ones(n), "no_id": np.zeros(n, bool), "doc_ids": r.permutation(n)})()
    for _ in range(6):
        lists, full = [], np.zeros(n, np.int64)
        for share, top in ((0.9, 40), (0.6, 90), (0.3, 400), (0.01, 9000)):
            d = np.flatnonzero(r.random(n) < share)
            s = r.integers(1, top, len(d))
            full[d] += s
            lists.append((d, s, int(s.max())))
        best = ls._Best(20)
        ls._walk(lists, block, best)
        order = np.lexsort((block.doc_ids, -full))[:20]
        assert best.score.tolist() == full[order].tolist() and best.ids.tolist() == block.doc_ids[order].tolist()


def test_index_holds_every_posting(spark):
    rows, _ = corpus()
    index = li.build_index(docs(spark, rows), 100)
    own = {(r.block, r.ord): (r.doc_id, r.cf) for r in index.where("term is null").collect()}
    assert sorted(map(str, own.values())) == sorted(str((d[0], len(terms(d[1])))) for d in rows)
    starts, at = {}, defaultdict(int)
    for b, o in sorted(own):
        starts[b, o] = at[b]
        at[b] += own[b, o][1] + 1
    got = Counter()
    for r in index.where("term is not null").collect():
        places = np.cumsum(r.gaps).tolist()
        inside = [next(o for (b, o), s in starts.items() if b == r.block and s <= p < s + own[b, o][1]) for p in places]
        assert r.cf == len(places) and r.df == len(set(inside))
        got.update((own[r.block, o][0], p - starts[r.block, o], r.term) for p, o in zip(places, inside, strict=True))
    assert got == Counter((d[0], p, t) for d in rows for p, t in enumerate(terms(d[1])))
    assert len({b for b, _ in own}) > 20


def slow_windows(rows, items, size, within):
    out = []
    for d, text, *_ in rows:
        w, hit, exact, near = terms(text), set(), set(), set()
        for item, t in items:
            v = terms(t)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                win = v[k : k + size]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        exact.add(str(item))
                if len(win) <= within and any(set(win) <= set(w[s : s + within]) for s in range(len(w))):
                    near.add(str(item))
        out.append((d, len(w), len(hit), tuple(sorted(exact)), tuple(sorted(near))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "chunk", "size", "within"), [(li.BLOCK, li.CHUNK, 10, 20), (80, 25, 10, 13), (300, 60, 4, 4), (300, 60, 6, 3)])
def test_windows_equal_brute_force(spark, monkeypatch, block, chunk, size, within):
    rows, items = corpus(7)
    monkeypatch.setattr(li.chunks, "__defaults__", (chunk,))
    monkeypatch.setattr(li.build_index, "__defaults__", (block,))
    got = dc.contamination(clash(docs(spark, rows), "exact", "near", "runs", "block"), clash(docs(spark, items, ITEMS), "item", "terms"), size, within).collect()
    want = slow_windows(rows, items, size, within)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.exact), tuple(r.near)) for r in got), key=str) == want
    assert any(x[3] for x in want) and any(set(x[4]) - set(x[3]) for x in want) or within < size
    for r in got:
        assert sum(x.end - x.start for x in r.runs) >= r.n_hit and all(0 <= x.start < x.end <= r.n_words for x in r.runs)


def test_search_and_windows_of_empty_tables(spark):
    some, none = docs(spark, corpus()[0]), docs(spark, [])
    items, no_items = docs(spark, [(1, "one two three")], ITEMS), docs(spark, [], ITEMS)
    assert ls.search(li.build_index(none), items).count() == 0 and ls.search(li.build_index(some), no_items).count() == 0
    assert dc.contamination(none, items).count() == 0
    clean = dc.contamination(some, no_items).collect()
    assert len(clean) == len(corpus()[0]) and all(r.n_hit == 0 and r.exact == [] and r.near == [] for r in clean)


def slow_audit(rows, labels):
    low = {}
    for d, t, *_ in rows:
        if d is not None:
            low[t or ""] = min(low.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, _, source, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > low[t]}
        parts[source or ""].append((fails, d in good, d in toxic))
    out = {}
    for part, own in parts.items():
        gone = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                here = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                gone[f] += len(here)
                failing = [x for x in own if x[0][f]]
                out[part, "".join(order), k] = [len(left), len(here), len(failing) - len(here), sum(sum(x[0].values()) == 1 for x in failing), sum(x[1] for x in here), sum(x[2] for x in here)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(gone[order[k - 1]])
    return out


def test_audit_equals_filtering_in_every_order(spark):
    texts = prose(60, 4, words=60, length=(30, 120))
    r = random.Random(1)
    rows = [(k, t + r.choice(["", " #", " ALL CAPS HERE AND THERE", " é%"]), "en", r.choice(["a", "b", None, ""]), 1) for k, t in enumerate(texts * 2)] + awkward() + [(None, texts[0], "en", "a", 1), (500, None, "en", "z", 1)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 110)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    labelled = docs(spark, labels, "doc_id long, quality int, toxic int")
    cells = fa.cells(clash(docs(spark, rows), "part", "fails", "digest", "n", "good", "low", "x"), clash(labelled, "good", "n"))
    got = {(x.part, x.filter_order, x.step): [x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley] for x in fa.audit(cells).collect()}
    assert got == slow_audit(rows, labels)
    assert fa.audit(fa.cells(docs(spark, []), labelled)).count() == 0
    no_labels = fa.audit(fa.cells(docs(spark, rows), docs(spark, [], "doc_id long, quality int, toxic int"))).collect()
    assert all(x.good_lost == 0 and x.toxic_lost == 0 for x in no_labels) and len(no_labels) == len(got)


def test_contamination_digest_is_of_the_sorted_ids(spark, sf_dir):
    got = dc.op12_decontamination(spark, sf_dir)
    assert {r.items_sha256 for r in got.where("n_items = 0").collect()} == {hashlib.sha256(b"").hexdigest()}
    assert got.where("contaminated and n_items > 0 and n_hit >= 10").count() > 0
