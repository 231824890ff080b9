"""Filter interactions, spelling variants and personal data against plain computations."""
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest

from folioscope.llm import filter_audit, linear_crf, personal_data, spelling_variants, word_queries
from folioscope.llm.store import stored

DOCS = "doc_id long, text string, source string, part string, label string, fails int, s0 string"
LABELS = "doc_id long, quality int, toxic int, part string"
WIDE = " ".join(f"w{i}" for i in range(60))
AUDITED = [
    (1, WIDE, "a"), (2, WIDE, "a"), (3, WIDE, "b"), (3, WIDE, "b"), (None, WIDE, "b"), (4, "", "a"), (5, None, None), (6, WIDE + " #", None),
    (7, "same " * 80, "a"), (8, WIDE.upper(), "b"), (9, "A B C", "c"), (10, "Été \U0001f600 " * 40, ""), (None, None, None), (11, WIDE + "|" + "X" * 900, "c"),
    (12, "x y\x00z\x1f " * 30, "c"), (13, "AB " * 9 + "same " * 60, "b"),
]
MARKED = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (4, 1, None), (7, 1, 1), (9, 0, 1), (99, 1, 1), (None, 1, 1), (11, 1, 0)]


def failures(rows):
    firsts = {}
    for key, text, _ in rows:
        known = firsts.get(text or "", None)
        if key is not None and (known is None or key < known):
            firsts[text or ""] = key
    for key, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        first = firsts.get(text)
        yield key, part or "", {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": first is not None and (key is None or key > first),
        }


def audited(rows, marks):
    good = {k for k, q, _ in marks if q == 1 and k is not None}
    toxic = {k for k, _, t in marks if t == 1 and k is not None}
    found, shares = {}, Counter()
    docs = list(failures(rows))
    for part in {p for _, p, _ in docs}:
        mine = [(k, f) for k, p, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                shares[part, letter] += len(gone)
                found[part, order, step] = [
                    len(left), len(gone), sum(f[letter] for _, f in mine) - len(gone), sum(f[letter] and sum(f.values()) == 1 for _, f in mine),
                    sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone),
                ]
    return {(p, o, s, *v, shares[p, o[s - 1]]) for (p, o, s), v in found.items()}


def test_every_order_against_removing_one_filter_after_another(spark):
    docs = stored(spark.createDataFrame([(*r, "p", "l", 7, "s") for r in AUDITED], DOCS), "audited")
    labels = spark.createDataFrame([(*r, "clash") for r in MARKED], LABELS)
    rows = filter_audit.audit(docs, labels).collect()
    assert len(rows) == 600 * 4  # the parts '', a, b and c
    assert {tuple(r) for r in rows} == audited(AUDITED, MARKED)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs, labels).collect() == []
    some = spark.createDataFrame([(1, WIDE, "a", "p", "l", 7, "s")], DOCS)
    assert all((r.kept, r.removed, r.shapley, r.good_lost) == (1, 0, 0, 0) for r in filter_audit.audit(some, labels).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1001])
def test_carry_save_counts(n):
    values = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    assert filter_audit.positional_popcount(values).tolist() == [int(sum(int(v) >> i & 1 for v in values)) for i in range(32)]


def test_truth_table_words():
    words = filter_audit.survival_words()
    assert all(bool(int(words[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


# Spelling variants

TEXTS = "doc_id long, text string, word string, n int, bucket int, pii string"


def plain_words(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word, alphabet):
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1 :]
        for c in alphabet:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]


def plain_variants(rows):
    words = plain_words(rows)
    alphabet = set("".join(words))
    near = {w: {e for e in edits(w, alphabet) if e in words and e != w and abs(len(e) - len(w)) <= 1} for w in words}
    form = {}
    for word, others in near.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            form[word] = best if words[best] >= 5 * words[word] else None
    out = set()
    for word, n in words.items():
        root = word
        while form.get(root):
            root = form[root]
        own = form.get(word)
        out.add((word, own, root, n, len(near[word]), words[own] if own else None))
    return out


def spelled(spark, rows):
    docs = stored(spark.createDataFrame([(*r, "clash", 1, 2, "p") for r in rows], TEXTS), "spelled")
    got = spelling_variants.variants(docs).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_variants_against_all_single_edits(spark):
    rng = random.Random(5)
    stems = ["therein", "inthere", "nierthe", "hereinto", "\u00e9t\u00e9ration", "st\u00f7rung", "aaaaaa", "aaaaaaa", "anthology", "x" * 70, "x" * 71, "y" * 40 + "z" * 30]
    pool = []
    for stem in stems:
        pool += [stem] * 400
        for _ in range(25):
            at = rng.randrange(len(stem) + 1)
            new = rng.choice("abeinrt\u00e9\u00fc")
            word = rng.choice([stem[:at] + new + stem[at:], stem[:at] + new + stem[at + 1 :], stem[:at] + stem[at + 1 :], stem[:at].upper() + stem[at:]])
            pool += [word] * rng.choice([3, 5, 6, 30, 90])
    pool += ["hereintx"] * 70 + ["hereixtx"] * 8  # a chain of two forms
    rng.shuffle(pool)
    rows = [(i if i % 31 else None, rng.choice([" ", "-", "1", "\u0100", "\n"]).join(pool[i * 97 : i * 97 + 97])) for i in range(len(pool) // 97 + 1)]
    rows += [(7, None), (8, ""), (9, "short words only"), *rows[:3]]
    got = spelled(spark, rows)
    assert got == plain_variants(rows)
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] and r[2] != r[1] for r in got)


def test_no_words(spark):
    assert spelled(spark, []) == spelled(spark, [(1, None), (2, ""), (3, "a b c")]) == set()


def test_near_words_share_a_signature():
    rng = random.Random(2)
    masks = spelling_variants.signature_masks()
    for first, second in ((1, 4), (1, 6), (3, 2)):
        assert len(spelling_variants.signature_masks(first, second)) == first * len(list(__import__("itertools").combinations(range(second), 2 // first)))
    for _ in range(300):
        word = "".join(rng.choice("abcdetr\u00e9") for _ in range(rng.randrange(6, 15)))
        other = rng.choice(list(edits(word, "abz")))
        letters = np.frombuffer((word + other).encode("latin-1"), dtype=np.uint8)
        one, two = spelling_variants.part_hashes(letters, np.array([0, len(word), len(word + other)]), 4)
        agree = sum(1 << p for p in range(4) if one[p] == two[p])
        assert any(agree & m == m for m in masks)


# Personal data

def plain_spans(text):
    """The rules as they are stated, one regular expression after another."""
    found = []
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 8 <= len(d) <= 15),
    ]
    for kind, rule, good in rules:
        for m in re.finditer(rule, text):
            if good(m.group(), re.sub("[^0-9]", "", m.group())):
                found.append((kind, m.start(), m.end()))
    return found


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def test_base_spans_against_the_stated_rules():
    rng = random.Random(3)
    pieces = ["a@b.c", "@", ".", "+1", "4663622617512349", " ", "-", "1.2.3.4", "300", "(5)", "x_y%", "256.1.1.1", "+", "0", "12 34", "\u00e9", "\U0001f600", "@m.de", "--", "..", "+49 (30) 1234567"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_long_runs_take_no_more_than_linear_time():
    for text in ("x" * 300_000, "1" * 300_000, "+1" + "." * 300_000, "a@" * 100_000, "1." * 150_000, "1 " * 150_000):
        assert len(personal_data.base_spans(text)) < 40_000


def small_model(rng, features=5, labels=3):
    return linear_crf.Model(rng.normal(size=(features, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels))


def path_score(model, scores, path):
    return model.start[path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))


def test_field_against_all_paths():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    bounds = np.array([0, 4, 5, 5, 8])
    ids, gold = rng.integers(-1, 5, (8, 3)), rng.integers(0, 3, 8)
    best, total = linear_crf.decode(model, ids, bounds), 0.0
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if lo < hi:
            scores = model.scores(ids[lo:hi])
            paths = {p: path_score(model, scores, p) for p in product(range(3), repeat=int(hi - lo))}
            assert tuple(best[lo:hi]) == max(paths, key=paths.get)
            total += paths[tuple(gold[lo:hi])] - np.log(sum(np.exp(v) for v in paths.values()))
    value, slope = linear_crf.likelihood(model, ids, bounds, gold)
    assert value == pytest.approx(total)
    for name in ("emit", "move", "start"):
        weights, got = getattr(model, name), getattr(slope, name)
        for at in np.ndindex(weights.shape):
            weights[at] += 1e-5
            up = linear_crf.likelihood(model, ids, bounds, gold)[0]
            weights[at] -= 2e-5
            down = linear_crf.likelihood(model, ids, bounds, gold)[0]
            weights[at] += 1e-5
            assert got[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return sorted(tuple(r) for r in personal_data.labelled_table(docs, 60).collect())


def test_tagger_on_held_out_rows(labelled):
    held = [r for i, r in enumerate(labelled) if i % 4 == 0]
    tagger = personal_data.fit_rows([r for i, r in enumerate(labelled) if i % 4], rounds=25)
    wanted = found = right = 0
    texts, spans = zip(*personal_data.sentences(held), strict=True)
    for text, gold, got in zip(texts, spans, personal_data.all_spans(list(texts), tagger), strict=True):
        gold, got = {s for s in gold}, {s[:3] for s in got}
        assert {s for s in plain_spans(text)} <= got
        wanted, found, right = wanted + len(gold), found + len(got), right + len(gold & got)
    assert right / wanted > 0.85 and right / found > 0.93, (right, wanted, found)


def test_spans_of_edge_rows(spark, labelled):
    tagger = personal_data.fit_rows(labelled, rounds=10)
    rows = [(1, "a.b@c.de and +1 (310) 555-4510 4663622617512349"), (2, ""), (3, None), (None, "no data"), (4, "x" * 60_000 + " 1.2.3.4"), (1, "a.b@c.de and +1 (310) 555-4510 4663622617512349")]
    docs = spark.createDataFrame([(*r, "w", 1, 2, "old") for r in rows], TEXTS)
    got = {(r.doc_id, r.text): r for r in personal_data.find(docs, tagger).collect()}
    assert got[(3, None)].pii == got[(2, "")].pii == got[(None, "no data")].pii == []
    assert [(s.kind, s.start, s.stop, s.base) for s in got[rows[4]].pii] == [("ip", 60_001, 60_008, True)]
    assert [s.kind for s in got[rows[0]].pii if s.base] == ["email"] and got[rows[0]].word == "w"
    masked = {r.doc_id: r.text for r in personal_data.masked(personal_data.find(docs, None)).collect()}
    assert masked[1].startswith("<email> and +1") and masked[4].endswith("x <ip>") and masked[3] is None
    assert personal_data.find(docs.limit(0), tagger).collect() == []
    assert personal_data.fit(docs.filter("text = 'no data'")) is None


def test_registered_query_tells_the_rules_spans(spark, tiny):
    rows = {r.doc_id: r for r in word_queries.op13(spark, tiny).collect()}
    texts = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        spans = plain_spans(text or "")
        row = rows[doc_id]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in spans) for k in personal_data.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(filter(None, row.spans.split(",")))
