import hashlib
import random
from collections import defaultdict

import pytest
from edges import documents, ids
from test_words import LOW, plain_words

from dyadic.llm import components, decontaminate, exact_dedup, jaccard_forest, line_templates


def test_cuckoo_index_against_a_dict():
    rnd = random.Random(5)
    index, plain = exact_dedup.CuckooIndex(4), {}
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for step in range(20_000):
        key = rnd.choice(keys)
        if rnd.random() < 0.4:
            assert index.delete(key) == (plain.pop(key, None) is not None)
        elif key not in plain:
            index.insert(key, step)
            plain[key] = step
        assert index.live == len(plain)
    assert dict(index.items()) == plain and index.resizes > 3
    assert all((index.find(k) is not None) == (k in plain) for k in keys)


def test_cuckoo_fingerprint_hits_are_verified():
    index = exact_dedup.CuckooIndex()
    a = bytes(range(32))
    b = a[:31] + b"\xff"  # same fingerprint and buckets, other content
    index.insert(a, 1)
    assert index.find(b) is None
    index.insert(b, 2)
    assert index.values[index.find(a)] == 1 and index.values[index.find(b)] == 2


def test_exact_duplicates_edges(spark):
    docs = documents(spark)
    got = exact_dedup.exact_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r.text or "").translate(LOW).encode()).hexdigest()].append(r.doc_id)
    for r in got:
        members = groups[r.text_sha256]
        assert r.group_size == len(members)
        assert r.keep_id == max((m for m in members if m is not None), default=None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_index_insert_and_delete(spark):
    docs = documents(spark)
    rows = exact_dedup.digests(docs)
    index = exact_dedup.build_index(rows)
    before = {bytes(r.digest): r.group_size for r in index.collect()}
    gone = rows.where("doc_id = 7").select("digest")
    after = {bytes(r.digest): r.group_size for r in exact_dedup.delete(index, gone, 3).collect()}
    dead = {bytes(r.digest) for r in gone.collect()}
    assert after == {k: v for k, v in before.items() if k not in dead}
    more = rows.selectExpr("digest", "doc_id keep_id", "rid keep_rid", "1L group_size")
    twice = {bytes(r.digest): r.group_size for r in exact_dedup.insert(index, more, 3).collect()}
    assert twice == {k: 2 * v for k, v in before.items()}


def test_line_templates_edges(spark):
    docs = documents(spark)
    out = line_templates.drop_recurring_lines(docs)
    assert ids(out) == ids(docs) and out.columns == [*docs.columns, "n_lines", "n_dropped"]
    by = {r.doc_id: r for r in out.collect() if r.doc_id not in (None, 7)}
    assert by[3].text is None and by[3].n_lines == 0 and by[4].text == "" and by[6].n_dropped == 0
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0


def test_line_templates_generalise_variable_fields(spark):
    body = "Call {} on {} for the latest prices of all our fine goods and wares today"
    docs = spark.createDataFrame(
        [(k, f"own line {w}\n" + body.format("5550" + str(k), f"{k}.{k}"))
         for k, w in enumerate(["alpha beta", "gamma", "delta epsilon zeta", "eta"])]
        + [(9, "prefix words\nCall one on two for the latest prices of all our fine goods and wares tomorrow")],
        "doc_id long, text string")
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    assert [out[k].n_dropped for k in (0, 1, 2, 3, 9)] == [1, 1, 1, 0, 0]
    assert all(out[k].text.startswith("own line") and "\n" not in out[k].text for k in (0, 1, 2))
    # one block of the tail may differ
    near = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "a b c d e f X h i j k l"),
                                  (3, "a b c Y e f X Z i j k l")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(near).collect()} == {1: 1, 2: 0, 3: 0}


def test_line_templates_short_lines_need_more_documents(spark):
    rows = [(k, f"short common line here\nbody{k} x{'y' * k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_dropped for r in line_templates.drop_recurring_lines(docs).collect()) == 11
    assert sum(r.n_dropped for r in line_templates.drop_recurring_lines(docs.limit(9)).collect()) == 0


def test_line_templates_drop_lines_of_any_length(spark):
    rows = [(k, f"Les.\nAnd ornd.\n\nPage {k}\nTotal 7\nown{k}\u00e9 x{'y' * k}") for k in range(12)]
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # numbers of short lines are no fields: the page numbers differ, the totals do not
    assert [out[k].n_dropped for k in range(12)] == [3] * 11 + [0]
    assert out[3].text == "\nPage 3\nown3\u00e9 xyyy" and out[11].text == rows[11][1]
    few = line_templates.drop_recurring_lines(spark.createDataFrame(rows[:9], "doc_id long, text string"))
    assert sum(r.n_dropped for r in few.collect()) == 0


def test_line_templates_keep_rows_of_numbers(spark):
    row = lambda k, n, mark="": " ".join(f"{mark}{k * 100 + j}.{k}" for j in range(n))
    table = lambda k: "\n".join([row(k, 12), row(k, 6), f"| {' | '.join(str(k + j) for j in range(9))} |",
                                 "Mean and median of " + row(k, 8),
                                 "The four columns " + row(k, 2) + " are left for all " + row(k, 2) + " to see " + row(k, 2)])
    docs = spark.createDataFrame([(k, table(k)) for k in range(12)], "doc_id long, text string")
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    # only the last line has constants enough
    assert [out[k].n_dropped for k in range(12)] == [1] * 11 + [0]
    assert all(out[k].text == table(k).rpartition("\n")[0] for k in range(11))
    same = spark.createDataFrame([(1, row(1, 12)), (2, row(1, 12)), (3, row(1, 11) + " 5")], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(same).collect()} == {1: 1, 2: 0, 3: 0}


def test_line_templates_of_scripts_without_blanks(spark):
    for passage in ("\u672c\u7f51\u7ad9\u7684\u5185\u5bb9\u672a\u7ecf\u8bb8\u53ef\u4e0d\u5f97\u8f6c\u8f7d",
                    "\u3053\u306e\u30b5\u30a4\u30c8\u306e\u7121\u65ad\u8ee2\u8f09\u3092\u7981\u3058\u307e\u3059",
                    "\u0e2a\u0e07\u0e27\u0e19\u0e25\u0e34\u0e02\u0e2a\u0e34\u0e17\u0e18\u0e34\u0e4c"):
        docs = spark.createDataFrame([(1, passage), (2, passage), (3, passage[:5])], "doc_id long, text string")
        assert {r.doc_id: r.n_dropped for r in line_templates.drop_recurring_lines(docs).collect()} == {1: 1, 2: 0, 3: 0}


def plain_contamination(docs, items, n=13):
    wins = defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        if w and i is not None:
            for s in range(max(1, len(w) - n + 1)):
                wins[tuple(w[s:s + n])].add(i)
    out = []
    for i, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for length in {len(x) for x in wins}:
            for s in range(len(w) - length + 1):
                ids_ = wins.get(tuple(w[s:s + length]))
                if ids_:
                    hit.update(range(s, s + length))
                    found |= ids_
        names = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def bench_items():
    passage = " ".join(f"w{k}" for k in range(30))
    return passage, [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
                     (2, "tie"), (3, passage), (3, passage), (10, "w3 W4 w5"), (None, "lorem ipsum"), (4, None), (5, ""),
                     (6, "x x x x x x x x x x x x x x")]


@pytest.mark.parametrize("segment_bytes", [16 << 20, 60])
def test_contamination_against_plain_python(spark, monkeypatch, segment_bytes):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", segment_bytes)
    passage, items = bench_items()
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(
        [(20, "Before. " + passage.upper() + " after"), (21, passage[:40]), (22, "x " * 30), (23, passage + " | " + passage),
         (24, " ".join(passage.split()[:12])), (25, ("filler " * 400) + passage)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert got == plain_contamination([tuple(r) for r in docs.collect()], items)
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def test_windows_are_a_table_met_by_their_rarest_term(spark):
    docs = spark.createDataFrame([(1, "w3 w4 w5 w3 w3"), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w3 w4 w5"), (7, "w3 w4 w5"), (2, "a b c d e f g h i j k l")], "item_id long, text string")
    index, words = decontaminate.build_index(docs), decontaminate.item_words(bench)
    rows = decontaminate.windows_of(index, words, 13).collect()
    assert [(r.items, len(r.window)) for r in rows] == [([1, 7], 3)]  # item 2 has words that no document has
    times = {r.term: r.n for r in index.where("n >= 0").collect()}
    assert times[rows[0].rarest] == 1  # w4 or w5, not w3
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.contamination(docs, bench).collect()} == {1: (3, 2), 2: (0, 0)}


def test_all_terms_index_gives_the_same(spark, monkeypatch):
    passage, items = bench_items()
    docs = spark.createDataFrame([(1, "say " + passage), (2, "w3 w4 w5"), (3, "none")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = sorted(map(tuple, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "MAX_VOCABULARY", 0)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect())) == some


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick brown sly fox"), (2, "fox brown quick"), (3, "quick brown a b c d fox")],
                                 "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    index, words = decontaminate.build_index(docs), decontaminate.item_words(items)
    at = {(r.segment, k): i for r in index.where("n < 0").collect() for k, i in enumerate(r.doc_ids)}
    hits = lambda slop: sorted(at[(r.segment, r.ord)] for r in
                               decontaminate.find_matches(index, words, slop=slop).collect())
    assert [hits(k) for k in (0, 1, 2, 3, 4)] == [[], [1, 2], [1, 2], [1, 2], [1, 2, 3]]


def plain_near(rows, t=0.8):
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    classes = sorted(set(sets), key=lambda s: sorted(s))
    size = {s: sets.count(s) for s in classes}
    links = defaultdict(list)
    for a, x in enumerate(classes):
        for y in classes[a + 1:]:
            if x and y and len(x & y) >= t * len(x | y):
                links[x].append(y)
                links[y].append(x)
    return sets, size, links


def near_copies():
    rnd = random.Random(3)
    base = [f"t{rnd.randrange(500)}" for _ in range(300)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 9)):
            w[rnd.randrange(300)] = f"n{rnd.randrange(10 ** 6)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(400 + k, " ".join(f"u{k}_{j}" for j in range(50))) for k in range(10)]
    return rows + [(500, "just three words"), (501, "Just, three WORDS"), (502, "just three")]


def test_near_duplicates_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "BLOCK", 16)  # several blocks a group
    docs = documents(spark).select("doc_id", "text").union(
        spark.createDataFrame(near_copies(), "doc_id long, text string")).repartition(4)
    rows = [tuple(r) for r in docs.collect()]
    sets, size, links = plain_near(rows)
    got = jaccard_forest.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    best = lambda s: max((i for (i, _), x in zip(rows, sets) if x == s and i is not None), default=None)
    want = sorted(((i, best(s), size[s], len(links[s]), sum(size[y] for y in links[s])) for (i, _), s in zip(rows, sets)),
                  key=repr)
    assert sorted(((r.doc_id, r.class_id, r.class_size, r.n_links, r.n_link_docs) for r in got), key=repr) == want
    # groups: linked classes share one, and each keeps exactly one row
    group = {s: r for s, r in zip(sets, [None] * len(sets))}
    by_class = {(r.class_id, r.class_size): r.group_id for r in got}
    for s, others in links.items():
        for y in others:
            assert by_class[(best(s), size[s])] == by_class[(best(y), size[y])]
    seen, n_groups = set(), 0
    for s in group:
        if s not in seen:
            n_groups += 1
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    assert sum(r.kept for r in got) == n_groups
    kept = jaccard_forest.keep_one_per_group(docs)
    assert kept.count() == n_groups and kept.columns == docs.columns
    assert jaccard_forest.near_duplicates(docs.limit(0)).count() == 0


def pairs_of(spark, copies, changes):
    """Texts of 200 words with a copy each, ``changes(k)`` of whose words differ."""
    rnd, rows = random.Random(9), []
    for k in range(copies):
        w = [f"p{k}x{j}" for j in range(200)]
        other = list(w)
        for at in rnd.sample(range(0, 200, 5), changes(k)):
            other[at] = f"q{k}x{at}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("threshold, recall", [(0.5, 0.9), (0.8, 0.999), (0.9, 0.999)])
def test_measured_recall(spark, monkeypatch, threshold, recall):
    monkeypatch.setattr(jaccard_forest, "TREES", 50 if threshold > 0.5 else 30)
    # similarities from just above the threshold on
    most = next(c for c in range(40, 0, -1) if (196 - 5 * c) >= threshold * (196 + 5 * c))
    docs = pairs_of(spark, 300, lambda k: max(1, most - k % 5))
    got = jaccard_forest.near_duplicates(docs, threshold, recall).collect()
    assert sum(r.n_links for r in got) >= 2 * 300 * recall - 4
    assert max(r.n_links for r in got) == 1  # unrelated texts are never linked


def test_prefixes_are_shortened_as_far_as_the_documents_need(spark, monkeypatch):
    seen = []
    links = jaccard_forest.verified_links
    monkeypatch.setattr(jaccard_forest, "verified_links", lambda *a: seen.append(a[-1]) or links(*a))
    jaccard_forest.near_duplicates(pairs_of(spark, 40, lambda k: 1)).count()
    assert seen == [8]  # near copies meet at full depth
    seen.clear()
    assert sum(r.n_links for r in jaccard_forest.near_duplicates(pairs_of(spark, 40, lambda k: 4)).collect()) == 80
    assert seen == [8, 7]  # pairs near the threshold call for shorter prefixes
    seen.clear()
    jaccard_forest.near_duplicates(pairs_of(spark, 5, lambda k: 40)).count()
    assert seen == [8, 7]  # without any pair the depth that suffices at the threshold


def test_matched_depth_reaches_the_recall():
    k = jaccard_forest.matched_depth(0.8, 0.99999)
    assert 1 - (1 - 0.8 ** k) ** jaccard_forest.TREES >= 0.99999
    assert jaccard_forest.matched_depth(0.8, 0.5) > k


def test_matched_depth_tells_when_no_depth_reaches_the_recall():
    with pytest.raises(ValueError):
        jaccard_forest.matched_depth(0.2, 0.99999)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 50)] + [(1000, k) for k in range(60, 90)] + [(5000, 5001), (7, 7)]
    got = {r.node: r.root for r in
           components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[k] for k in range(51)}) == 1 and len({got[k] for k in (1000, *range(60, 90))}) == 1
    assert got[5000] == got[5001] and len(set(got.values())) == 3
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
