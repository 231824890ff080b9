"""Language mixtures, perplexity, word counts and piece search against plain computations."""
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from folioscope.llm import kneser_ney, mixture_language, piece_viterbi
from folioscope.llm.queries import all_queries
from folioscope.llm.store import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(tiny):
    return duckdb.sql(f"select doc_id, coalesce(text, ''), lang from '{tiny}/documents.parquet'").fetchall()


def test_quality_counts(spark, tiny, docs):
    got = {r.doc_id: r for r in all_queries()["op1_perplexity_bands"](spark, tiny).collect()}
    for d, text, _ in docs:
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
        assert r.base_failed or r.kept == (r.nll_low <= r.nll_adjusted <= r.nll_high)


def test_clean_documents_are_kept(spark, tiny):
    got = {r.doc_id: r.kept or r.base_failed for r in all_queries()["op1_perplexity_bands"](spark, tiny).collect()}
    labelled = duckdb.sql(f"select doc_id from '{tiny}/labels.parquet' where quality = 1").fetchall()
    assert labelled and all(got[d] for (d,) in labelled)


def plain_model(texts):
    """Modified Kneser-Ney by dictionaries: p(symbols) of an n-gram given as a tuple."""
    counts = {5: Counter()}
    for text in texts:
        symbols = [0] * 4 + [ord(c) for c in text]
        counts[5].update(tuple(symbols[i : i + 5]) for i in range(len(symbols) - 4))
    for k in range(4, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, total, freed = {}, {}, {}
    for k, table in counts.items():
        t = Counter(table.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else 0
        d = [0] + [i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0 for i in (1, 2, 3)]
        discount[k] = [x if 0 < x < i else 0.5 for i, x in enumerate(d)]
        total[k], freed[k] = defaultdict(int), defaultdict(float)
        for g, n in table.items():
            total[k][g[:-1]] += n
            freed[k][g[:-1]] += discount[k][min(n, 3)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / kneser_ney.SYMBOLS
        n, context = counts[k][g], g[:-1]
        if not total[k][context]:
            return p(g[1:])
        own = n - discount[k][min(n, 3)] if n else 0
        return own / total[k][context] + freed[k][context] / total[k][context] * p(g[1:])

    return p


def test_kneser_ney_equals_plain_estimate(spark):
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "été à la mer", "on and on and on"] * 2 + ["x"]
    table = stored(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), "kn")
    model = kneser_ney.fit(table)
    p = plain_model(texts)
    for text in [*texts[:6], "the mat sat", "zzz été qq"]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        points, begins = kneser_ney.symbols(raw, np.array([0, len(raw)]))
        got = model.log_probabilities(points, begins, np.array([kneser_ney.language_key("en")]))
        symbols = [0] * 4 + [ord(c) for c in text]
        assert got.tolist() == pytest.approx([math.log(p(tuple(symbols[i : i + 5]))) for i in range(len(text))], abs=1e-3)


def test_no_ngram_is_dropped(spark):
    rng = np.random.default_rng(5)
    rows = [("".join(map(chr, rng.integers(97, 123, 400))), lang) for lang, n in (("en", 120), ("fr", 20), (None, 2)) for _ in range(n)]
    counts = Counter((lang, ("\0" * 4 + t)[i : i + 5]) for t, lang in rows for i in range(len(t)))
    model = kneser_ney.fit(stored(spark.createDataFrame(rows, "text string, lang string"), "kn"), part=10_000)
    assert len(model.orders[5]) > 3
    assert sum(len(part.value[0]) for part in model.orders[5]) == len(counts) > 50_000
    for lang in ("en", "fr", None):  # every n-gram of the texts is found, those of small languages too
        texts = [t.encode() for t, x in rows if x == lang]
        points, begins = kneser_ney.symbols(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)]))
        gram, key = kneser_ney.distinct([(points, begins, np.full(len(texts), kneser_ney.language_key(lang)))])
        assert model.find(5, kneser_ney.entry_hash(key, gram))[0].all()


def test_held_out_accuracy(spark, tiny, docs):
    lang = {d: x for d, _, x in docs}
    rows = all_queries()["op6_language_mixture"](spark, tiny).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(docs) and len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_two_languages_in_one_text(spark, tiny, docs):
    model = mixture_language.fit(spark.read.parquet(f"{tiny}/documents.parquet"))
    longest = {x: max((t for _, t, lang in docs if lang == x and t.islower() is False), key=len)[:6000] for x in ("en", "fr", "de")}
    texts = [longest["en"] + " " + longest["fr"], longest["en"], longest["de"] + " " + longest["en"][:2000]]
    rows = mixture_language.identify(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), model).orderBy("i").collect()
    share = [{x.lang: x.share for x in r.languages} for r in rows]
    assert set(share[0]) == {"en", "fr"} and 0.4 < share[0]["en"] < 0.6
    assert share[1].get("en", 0) > 0.95
    assert rows[2].lang_pred == "de" and 0.15 < share[2]["en"] < 0.35


@pytest.fixture(scope="module")
def vocabulary():
    return piece_viterbi.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def full_search(v, data):
    best, back = [0], [None]
    for j in range(1, len(data) + 1):
        top, come = best[j - 1] + v.byte_score, (j - 1, int(v.byte_id[data[j - 1]]))
        for n in range(1, min(v.longest, j) + 1):
            piece = v.ids.get(data[j - n : j])
            if piece is not None and best[j - n] + int(v.score[piece]) >= top:
                top, come = best[j - n] + int(v.score[piece]), (j - n, piece)
        best.append(top), back.append(come)
    out, j = [], len(data)
    while j:
        j, piece = back[j]
        out.append(piece)
    return out[::-1]


def test_piece_search_equals_full_search(vocabulary, docs):
    rng = np.random.default_rng(5)
    parts = list("ab the ing\n é▁") + ["\U0001f600", "tion", "\x00", "　"]
    texts = ["", " ", "hello world", "  a  b\n\nc\t", "▁ ▁lit", "x" * 700, "日本語" * 200]
    texts += ["".join(rng.choice(parts, rng.integers(0, 300))) for _ in range(60)]
    texts += sorted((t for _, t, _ in docs), key=len)[:40]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    ids, counts = piece_viterbi.encode_slice(vocabulary, *piece_viterbi.with_blank(data, offs))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        mine, at = ids[at : at + n].tolist(), at + n
        assert mine == full_search(vocabulary, b" " + text.encode()) == piece_viterbi.streamed(vocabulary, b" " + text.encode())
        assert piece_viterbi.decode_ids(vocabulary, np.array(mine, dtype=np.int64)).decode() == text


def test_streaming_keeps_a_bounded_window(vocabulary):
    search, most = piece_viterbi.StreamingViterbi(vocabulary), 0
    for byte in b" abcabcabcab thequickbrownfox" * 300:
        for _ in search.feed(bytes([byte])):
            pass
        most = max(most, len(search.back))
    assert most < 20 * vocabulary.longest and len(search.tail) <= vocabulary.longest


def test_pieces_query(spark, tiny, docs):
    rows = all_queries()["op8_piece_viterbi"](spark, tiny).collect()
    assert len(rows) == len(docs) and all(r.round_trip for r in rows)


def plain_mixture(likelihood, penalty, rounds):
    """Shares of one text from the likelihoods of its words, set by set, word by word."""
    n, langs = likelihood.shape

    def climb(share, steps):
        for _ in range(steps):
            new = np.zeros(langs)
            for word in likelihood:
                joint = word * share
                new += joint / joint.sum()
            new /= n
            moved, share = np.abs(new - share).max(), new
            if moved < mixture_language.SETTLED:
                break
        return share, sum(np.log((w * share).sum()) for w in likelihood)

    full, _ = climb(np.full(langs, 1 / langs), rounds)
    order = np.argsort(-full, kind="stable")
    best = None
    for m in range(1, langs + 1):
        share = np.zeros(langs)
        share[order[:m]] = full[order[:m]] + 1e-6
        share, fit = climb(share / share.sum(), rounds if m > 1 else 0)
        score = fit - 0.5 * penalty * m * np.log(n + 1)
        if best is None or score > best[0]:
            best = (score, share)
        elif m > 2:
            break
    return best[1]


def test_mixtures_against_one_text_at_a_time(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("text", "lang")
    model = mixture_language.fit(docs)
    texts = [r.text for r in docs.limit(60).collect()]
    texts += [f"{a[:400]} {b[:300]}" for a, b in zip(texts[:20], texts[20:40])] + ["", "12", "the", "le la les " * 3]
    raw = [t.lower().encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    together = mixture_language.mixtures(model, data, offs, 4.0, 8)
    for i, own in enumerate(raw):
        alone = mixture_language.mixtures(model, np.frombuffer(own, dtype=np.uint8), np.array([0, len(own)]), 4.0, 8)
        assert (alone[0] == together[i]).all()  # neighbours change nothing
        logs, of = mixture_language.word_likelihoods(model, np.frombuffer(own, dtype=np.uint8), np.array([0, len(own)]))
        if len(of):
            want = plain_mixture(np.exp(logs - logs.max(axis=1, keepdims=True)).astype(float), 4.0, 8)
            assert want.argmax() == together[i].argmax() and np.abs(want - together[i]).max() < 2e-3
        else:
            assert not together[i].any()
