"""Repeated lines, fingerprints, near duplicates and repeated passages against brute force."""
import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from folioscope.llm import chosen_path, collinear_chains, line_patience, winnowing
from folioscope.llm.queries import all_queries
from folioscope.llm.store import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(tiny):
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{tiny}/documents.parquet' order by doc_id").fetchall()


def run(spark, texts, operator, **options):
    table = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "texts")
    return sorted(operator(table, **options).collect(), key=lambda r: r.doc_id)


# --- lines


def test_patience_is_a_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 12, rng.integers(0, 30)).tolist(), rng.integers(0, 12, rng.integers(0, 30)).tolist()
        pairs = line_patience.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    a = list(range(100))
    b = [*range(1000, 1010), *range(20, 60), 7, *range(60, 90)]
    assert [j for _, j in line_patience.patience(a, b)] == [*range(10, 50), *range(51, 81)]


def test_longest_chain_is_longest():
    rng = np.random.default_rng(1)
    for _ in range(100):
        values = rng.permutation(12).tolist()
        best = [1] * 12
        for i in range(12):
            best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
        assert len(line_patience.longest_chain(values)) == max(best)


def line(i):
    return f"line number {i} holds some words that no other line has {i * 7919}"


def test_blocks_are_cut_from_the_later_text(spark):
    a = "\n".join(line(i) for i in range(10))
    texts = [
        a,
        "\n".join([line(100), *(line(i) for i in range(3, 7)), line(101)]),  # a block of the first
        a,  # a copy
        "\n".join(line(i) for i in (200, 9, 201, 2)),  # two lines out of order: one is aligned
        line(300),
        "short one\n" + line(301), "short one\n" + line(302),  # too few words to be cut
    ]
    rows = run(spark, texts, line_patience.without_repeats)
    assert [r.text for r in rows][:3] == [a, line(100) + "\n" + line(101), ""]
    assert [r.lines_cut for r in rows] == [0, 4, 10, 1, 0, 0, 0] and rows[1].sources == [0]
    assert rows[5].text == texts[5] and rows[6].text == texts[6]


def test_large_groups_of_near_copies_are_linked(spark):
    body = [line(i) for i in range(8)]
    texts = ["\n".join([*body[:4], line(1000 + k), *body[4:]]) for k in range(80)]  # every line but one in 80 texts
    rows = run(spark, texts, line_patience.without_repeats, rare=10)
    assert [r.text for r in rows[1:]] == [line(1000 + k) for k in range(1, 80)]


def test_frequent_blocks_are_cut_beside_rare_lines(spark):
    one, other, rare = ([line(k + i) for i in range(8)] for k in (0, 100, 200))
    texts = [[line(1000), *one], [line(1001), *other], [line(1002), *rare[:6]]]
    texts += [[line(2000 + 2 * k + i), *block] for k in range(70) for i, block in enumerate((one, other))]
    texts += [[line(3000), *rare[:6], *one], [line(3001), *one, line(3002), *other]]
    rows = run(spark, ["\n".join(t) for t in texts], line_patience.without_repeats)
    assert [r.text for r in rows[:3]] == ["\n".join(t) for t in texts[:3]]
    assert [r.text for r in rows[3:-2]] == [t[0] for t in texts[3:-2]]
    assert rows[-2].text == line(3000) and rows[-2].sources == [0, 2]
    assert rows[-1].text == line(3001) + "\n" + line(3002) and rows[-1].sources == [0, 1]


def test_unique_lines_stay_and_exact_copies_go(spark, tiny, docs):
    rows = {r.doc_id: r for r in line_patience.without_repeats(spark.read.parquet(f"{tiny}/documents.parquet")).collect()}
    lines = Counter(x for _, t in docs for x in t.split("\n"))
    seen = set()
    for d, text in docs:
        kept = rows[d].text.split("\n")
        if text in seen and len(WORD.findall(text)) < line_patience.MIN_WORDS:
            assert rows[d].text == text
        elif text in seen:
            assert rows[d].text == "" and rows[d].lines_cut == rows[d].n_lines
        else:
            assert all(x in kept for x in text.split("\n") if lines[x] == 1 and WORD.search(x))
            assert len(kept) + rows[d].lines_cut == text.count("\n") + 1 or rows[d].text == ""
        seen.add(text)


# --- fingerprints


def test_winnowing_keeps_its_guarantees(spark, docs):
    texts = [t for _, t in docs[:60]] + ["", "one two", "a b c d e", "same " * 40, "x " * 16, "w1 w2 w3 w4 w5 w6"]
    table = stored(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "winnow")
    rows = winnowing.with_fingerprint(table, "text", "f").withColumn("p", winnowing.positions(winnowing.F.col("f"))).orderBy("i").collect()
    k, w, seen = winnowing.K, winnowing.WINDOW, {}
    for r in rows:
        words = WORD.findall(r.text)
        picks = [(p.hash, p.position) for p in r.p]
        at = [q for _, q in picks]
        assert at == sorted(set(at))
        if not words:
            assert picks == []
            continue
        grams = max(1, len(words) - k + 1)
        if len(words) >= k:
            assert all(q < grams for q in at)
            assert all(any(i <= q < i + w for q in at) for i in range(max(1, grams - w + 1)))  # a choice in every window
            for h, q in picks:
                assert seen.setdefault(tuple(words[q : q + k]), h) == h  # equal grams, equal hashes
        else:
            assert at == [0]
    by_text = {r.text: [p.position for p in r.p] for r in rows}
    assert by_text["same " * 40] == list(range(w - 1, 36))  # of equal hashes the rightmost


def test_minimum_of_each_window_is_chosen(spark, docs):
    text = max((t for _, t in docs), key=len)
    one = spark.createDataFrame([(text,)], "text string")
    grams = winnowing.with_fingerprint(one, "text", "g", window=1)
    all_ = [(p.hash, p.position) for p in grams.select(winnowing.positions(winnowing.F.col("g")).alias("p")).first().p]
    assert [q for _, q in all_] == list(range(len(WORD.findall(text)) - winnowing.K + 1))
    want = {min(all_[i : i + winnowing.WINDOW], key=lambda p: (p[0], -p[1])) for i in range(len(all_) - winnowing.WINDOW + 1)}
    got = winnowing.with_fingerprint(one, "text", "f").select(winnowing.positions(winnowing.F.col("f")).alias("p")).first().p
    assert {(p.hash, p.position) for p in got} == want


def test_fingerprint_query(spark, tiny, docs):
    got = {r.doc_id: r for r in all_queries()["op3_winnowing"](spark, tiny).collect()}
    down = docs[::-1]
    sets = {d: {x.split(".")[0] for x in got[d].fingerprint.split()} for d, _ in docs}
    by_text = {}
    for i, (d, text) in enumerate(down):
        following = down[(i + 1) % len(down)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[1][:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        union = sets[d] | sets[following[0]]
        assert got[d].near_next == pytest.approx(len(sets[d] & sets[following[0]]) / len(union) if union else 1.0)
        own = {x.split(".")[0] for x in got[d].edited_fingerprint.split()}
        assert got[d].near_edited == pytest.approx(len(sets[d] & own) / len(sets[d] | own) if sets[d] | own else 1.0)
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


@pytest.mark.parametrize("ids", [[5], [1, 2, 3], [10**15, -4, 7, 8, 9, 10**15 + 1, 0], list(range(0, 3000, 7))])
def test_next_text_for_any_ids(spark, ids):
    table = stored(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string"), "ids")
    got = {r.doc_id: r.next_text for r in winnowing.with_next(table, bucket_rows=2).collect()}
    down = sorted(ids, reverse=True)
    assert got == {d: f"text {down[(i + 1) % len(down)]}" for i, d in enumerate(down)}


# --- near duplicates


def shingle_set(text, n=5):
    words = WORD.findall(text)
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)] if words else [])


def brute_force(texts):
    """class of each text, and the number of other sets linked to its own."""
    sets = [shingle_set(t) for t in texts]
    linked = {}
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
                if a != b:
                    linked.setdefault(a, set()).add(b)
                    linked.setdefault(b, set()).add(a)
    return [root(i) for i in range(len(texts))], [len(linked.get(s, ())) for s in sets]


def test_near_duplicates_of_the_documents(spark, tiny, docs):
    rows = sorted(all_queries()["op4_chosen_path"](spark, tiny).collect(), key=lambda r: r.doc_id)
    classes, links = brute_force([t for _, t in docs])
    assert [r.class_id for r in rows] == [docs[c][0] for c in classes]
    assert [r.n_links for r in rows] == links


def test_large_groups_meet_in_blocks(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts = []
    for k in range(700):  # near copies: more than a cell holds
        words = list(base)
        for _ in range(k % 4):
            words[rng.integers(0, len(words))] = f"edit{k}"
        texts.append(" ".join(words))
    for k in range(300):  # one common passage of 60 words, otherwise different
        texts.append(" ".join([*base[:60], *(f"own{k}x{i}" for i in range(120))]))
    rows = run(spark, texts, chosen_path.near_duplicates, limit=40)
    classes, links = brute_force(texts)
    assert sum(r.class_id == c for r, c in zip(rows, classes, strict=True)) >= 0.995 * len(texts)
    assert sum(r.n_links == n for r, n in zip(rows, links, strict=True)) >= 0.99 * len(texts)
    assert sum(r.first_of_class for r in rows) == len({r.class_id for r in rows})


def test_splits_do_not_shuffle_tokens(spark, monkeypatch):
    plans, store = [], chosen_path.stored

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return store(df, name)

    monkeypatch.setattr(chosen_path, "stored", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{i}" for i in range(60)]
        texts = [" ".join([*words[:k], f"x{k}", *words[k:]]) for k in range(60)]
        rows = run(spark, texts, chosen_path.near_duplicates, limit=10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.class_id for r in rows} == {min(r.class_id for r in rows)}
    assert any(name == "path-sizes" for name, _ in plans)
    assert not [name for name, plan in plans if name in ("paths", "path-sizes") and "hashpartitioning(_row" in plan]


def test_what_cannot_be_split_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "DEEPEST", 1, raising=False)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(60):
        own = [*base[:50], *(f"own{k}x{i}" for i in range(60)), *base[50:]]
        texts += [" ".join(own), " ".join([*own[:80], f"edit{k}", *own[81:]])]
    rows = run(spark, texts, chosen_path.near_duplicates, limit=10)
    assert sum(rows[i].class_id == i - 1 for i in range(1, 120, 2)) == 60


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    texts, pairs = [], []
    for k in range(300):
        words = [f"p{k}w{i}" for i in range(200)]
        other = list(words)
        for at in rng.choice(np.arange(5, 195, 10), 4, replace=False):  # up to 20 of 196 shingles on each side
            other[at] = f"changed{k}{at}"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(words), " ".join(other)]
    truth = [p for p in pairs if len(shingle_set(texts[p[0]]) & shingle_set(texts[p[1]])) >= 0.8 * len(shingle_set(texts[p[0]]) | shingle_set(texts[p[1]]))]
    rows = run(spark, texts, chosen_path.near_duplicates)
    assert len(truth) > 200
    found = sum(rows[a].class_id == rows[b].class_id for a, b in truth)
    assert found >= 0.97 * len(truth)
    assert all(rows[a].class_id != rows[b].class_id for a, b in zip(range(1, len(texts) - 1, 2), range(2, len(texts), 2), strict=True))


# --- passages


def test_chains_are_best(spark):
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 12))
        x, y = rng.integers(0, 60, n), rng.integers(0, 60, n)
        order = sorted(range(n), key=lambda i: (x[i], y[i]))
        best = {}
        for j in order:  # every predecessor, without the tree
            options = [(0.0, -1)] + [(best[i] - collinear_chains.GAP * (x[j] - x[i] + y[j] - y[i]), i) for i in best if x[i] < x[j] and y[i] < y[j]]
            value, i = max(options, key=lambda o: o[0])
            best[j] = value + (collinear_chains.K if i < 0 else min(collinear_chains.K, x[j] - x[i], y[j] - y[i]))
        found = collinear_chains.chains(x, y)
        assert all(a <= b and c <= d for a, b, c, d in found)
        if found:
            assert max(best.values()) >= collinear_chains.K


def test_passages_cover_exact_repeats(spark, tiny, docs):
    rows = {r.doc_id: r for r in all_queries()["op5_collinear_chains"](spark, tiny).collect()}
    seen, total, missed = set(), 0, 0
    for d, text in docs:
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 50]) for i in range(len(words) - 49)]
        exact = {k for i, g in enumerate(windows) if g in seen for k in range(i, i + 50)}
        seen.update(windows)
        mine = {k for p in rows[d].passages for k in range(p.start, p.stop)}
        assert rows[d].n_words == len(words) and rows[d].n_repeated == len(mine)
        total, missed = total + len(exact), missed + len(exact - mine)
    assert total > 1000 and missed <= 0.01 * total


def test_fuzzy_passages(spark):
    rng = np.random.default_rng(8)
    passage = [f"s{i}" for i in range(80)]
    edited = list(passage)
    for at in (11, 29, 30, 52, 70):
        edited[at] = "edit"
    del edited[40]
    own = lambda k, n: [f"own{k}n{i}" for i in range(n)]
    texts = [[*own(0, 50), *passage, *own(0, 20)], [*own(1, 90), *edited, *own(2, 33)], own(3, 120), [*own(4, 10), *passage[:20], *own(5, 60)]]
    texts += [[*own(10 + k, int(rng.integers(5, 40))), *passage] for k in range(50)]
    rows = run(spark, [" ".join(t) for t in texts], collinear_chains.repeated_passages)
    assert rows[0].n_repeated == 0 and rows[0].n_repeats == 51
    (p,) = rows[1].passages
    assert p.source == 0 and abs(p.start - 90) <= 1 and abs(p.stop - 169) <= 1 and abs(p.source_start - 50) <= 1 and p.matches >= 72
    assert rows[2].n_repeated == rows[3].n_repeated == 0
    assert all(r.n_repeated == 80 for r in rows[4:])


@pytest.mark.parametrize("first,between,second", [(300, 200, 60), (60, 100, 60), (300, 60, 60), (60, 300, 400), (60, 150, 300)])
def test_all_passages_of_two_documents(spark, first, between, second):
    shared = [f"s{i}" for i in range(first + second)]
    own = lambda k, n: [f"own{k}n{i}" for i in range(n)]
    texts = [[*own(k, 20), *shared[:first], *own(k + 10, between), *shared[first:], *own(k + 20, 20)] for k in range(2)]
    rows = run(spark, [" ".join(t) for t in texts], collinear_chains.repeated_passages)
    if first > between < second:  # one passage, as the words between cost less than either side gives
        assert [(p.start, p.stop) for p in rows[1].passages] == [(20, 20 + first + between + second)]
        return
    at = 20 + first + between
    assert [(p.start, p.stop) for p in rows[1].passages] == [(20, 20 + first), (at, at + second)]
    assert rows[1].n_repeated == first + second and rows[0].n_repeats == 2


def test_stretches_are_all_maximal():
    rng = np.random.default_rng(9)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = list(range(n))
        c = [x if rng.random() < 0.6 else 1000 + x for x in a]
        value = [1 if x == y else -1 for x, y in zip(a, c, strict=True)]
        want, todo = [], [(0, n)]
        while todo:  # the best range, the shortest of equals; then left and right of it
            lo, hi = todo.pop()
            best = max(((sum(value[i:j]), i - j, -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
            if best[0] > 0:
                i, j = -best[2], -best[2] - best[1]
                want.append((best[0], i, j))
                todo += [(lo, i), (j, hi)]
        got = collinear_chains.stretches(a, c)
        assert sum(2 * m - (stop - start) for start, stop, _, _, m in got) == sum(v for v, _, _ in want)
        assert max((2 * m - (stop - start) for start, stop, _, _, m in got), default=0) == max((v for v, _, _ in want), default=0)


@pytest.mark.parametrize("length,every,least", [(30, 0, 0.93), (33, 0, 0.93), (60, 10, 0.93), (60, 8, 0.9), (80, 10, 0.95), (100, 8, 0.97)])
def test_recall_of_passages_with_evenly_spread_edits(spark, length, every, least):
    """Pairs of documents that share one passage, every so many words of it changed in the later one."""
    rng = np.random.default_rng(length + every)
    pairs, texts = 150, []
    for k in range(pairs):
        passage = [f"s{k}w{i}" for i in range(length)]
        shift = int(rng.integers(0, every)) if every else 0
        edited = [f"e{k}w{i}" if every and (i + shift) % every == every - 1 else w for i, w in enumerate(passage)]
        for side, middle in enumerate((passage, edited)):
            texts.append(" ".join([*(f"o{k}{side}a{i}" for i in range(60)), *middle, *(f"o{k}{side}b{i}" for i in range(60))]))
    rows = run(spark, texts, lambda d: collinear_chains.repeated_passages(d, min_words=25))
    assert all(r.n_repeated == 0 for r in rows[::2])
    found = sum(any(p.source == 2 * k and p.start < 60 + length and p.stop > 60 for p in rows[2 * k + 1].passages) for k in range(pairs))
    covered = [r.n_repeated for r in rows[1::2] if r.passages]
    assert found >= least * pairs and min(covered) >= 0.6 * length and max(covered) <= length + 4


def test_every_common_run_of_nine_words_has_a_seed():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(9, 30))
        run_ = rng.integers(0, 1 << 62, n).astype(np.uint64)
        found = []
        for _ in range(2):
            own = [rng.integers(0, 1 << 62, int(rng.integers(0, 12))).astype(np.uint64) for _ in range(3)]
            of = np.repeat([0, 1, 1, 1, 2], [len(own[0]), len(own[1]), n, 5, len(own[2])])
            hashes = np.concatenate([own[0], own[1], run_, rng.integers(0, 1 << 62, 5).astype(np.uint64), own[2]])
            at = len(own[0]) + len(own[1])
            grams, first = collinear_chains.sampled(hashes, of)
            assert (of[first] == of[first + collinear_chains.K - 1]).all()
            found.append(dict(zip((first - at).tolist(), grams.tolist(), strict=True)))
        common = [k for k in range(n - collinear_chains.K + 1) if k in found[0] and found[0][k] == found[1].get(k)]
        assert len(common) >= (n - collinear_chains.K + 1) // collinear_chains.WINDOW


@pytest.mark.parametrize("length,every", [(30, 0), (60, 10)])
def test_no_passage_with_long_runs_is_left_out(spark, length, every):
    rng = np.random.default_rng(length)
    pairs, texts = 400, []
    for k in range(pairs):
        passage = [f"s{k}w{i}" for i in range(length)]
        edited = [f"e{k}w{i}" if every and i % every == every - 1 else w for i, w in enumerate(passage)]
        for side, middle in enumerate((passage, edited)):
            own = [[f"o{k}{side}{c}{i}" for i in range(int(rng.integers(20, 60)))] for c in "ab"]
            texts.append(" ".join([*own[0], *middle, *own[1]]))
    rows = run(spark, texts, collinear_chains.repeated_passages)
    assert all(any(p.source == 2 * k for p in rows[2 * k + 1].passages) for k in range(pairs))
