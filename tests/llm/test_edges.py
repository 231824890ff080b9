"""Nulls in any column, empty and very long texts, ties and repeated rows, empty tables, columns with clashing names."""
import public_tokenizers
import pytest

from folioscope.llm import (
    chosen_path, collinear_chains, line_patience, mixture_language, pfor_tokens, piece_viterbi, quality_perplexity, slot_shards, source_mix, winnowing,
)
from folioscope.llm.store import shared_folder, stored

PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000)) + "\n" + "x" * 50_000
SENTENCE = "the quick brown fox jumps over the lazy dog while twelve grey geese look on from the far side of the pond"
CLASHING = "size int, shard int, score double, kept boolean, sources string, passages string, class_id string, n_words int, _row int, ids string, virtual_slot string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
EXTRA = (1, 2, 0.5, True, "s", "p", "c", 3, 4, "i", "v")
ROWS = [
    (1, SENTENCE, "en", "a"), (2, "", "en", "a"), (3, None, "en", None), (4, LONG, None, "b"), (None, SENTENCE, "en", "b"), (6, SENTENCE, "en", "a"),
    (6, SENTENCE, "en", "a"), (7, "   \n\t ", "fr", "c"), (8, "12 34 !!", "fr", "c"), (9, "été à la plage avec les enfants", "fr", "c"), (None, None, None, None),
    (10, "日本語の文章" * 30, "ja", "d"), (11, "\U0001f600 ▁ x\x00y", "en", "d"), (12, SENTENCE + " again", "en", ""),
]


@pytest.fixture(scope="module")
def edge(spark):
    return stored(spark.createDataFrame([(*r, 0, *EXTRA) for r in ROWS], SCHEMA), "edge")


@pytest.fixture(scope="module")
def nothing(spark):
    return stored(spark.createDataFrame([], SCHEMA), "nothing")


def quality(docs):
    return quality_perplexity.judged(docs)


def lines(docs):
    return line_patience.without_repeats(docs)


def prints(docs):
    rows = winnowing.with_next(docs.select("doc_id", "text", "size"))
    return winnowing.with_fingerprint(rows, "text", "f")


def near(docs):
    return chosen_path.near_duplicates(docs)


def passages(docs):
    return collinear_chains.repeated_passages(docs)


def languages(docs):
    return mixture_language.identify(docs, mixture_language.fit(docs))


def pieces(docs):
    return piece_viterbi.decode(piece_viterbi.encode(docs, PIECES), PIECES)


def tokens(docs):
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/edge-{id(docs)}"
    pfor_tokens.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return pfor_tokens.read_tokens(spark, path).join(pfor_tokens.segment_starts(spark, path), ["part", "seq"])


def mixture(docs):
    return source_mix.taken_words(source_mix.mix(stored(source_mix.with_sizes(docs), "edge-mix")))


def shards(docs):
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/edge-map-{id(docs)}"
    _, version = slot_shards.balance(docs, "doc_id", "n_chars", 3, folder)
    return slot_shards.assign(docs, "doc_id", slot_shards.read_map(spark, folder, version), ["doc_id"])


OPERATORS = [quality, lines, prints, near, passages, languages, pieces, tokens, mixture, shards]


@pytest.mark.parametrize("operator", OPERATORS)
def test_every_row_has_a_result(operator, edge):
    assert len(operator(edge).collect()) == len(ROWS)


@pytest.mark.parametrize("operator", OPERATORS)
def test_an_empty_table_gives_an_empty_result(operator, nothing):
    assert operator(nothing).collect() == []


def test_defined_results(edge):
    by = lambda df, *c: {(r.doc_id, r.text): tuple(r[x] for x in c) for r in df.collect()}
    found = by(languages(edge), "lang_pred", "score")
    assert found[(None, None)] == found[(2, "")] == found[(7, "   \n\t ")] == found[(8, "12 34 !!")] == ("und", 0.0)
    assert found[(10, "日本語の文章" * 30)][0] == "ja"
    assert all(r.decoded == r.text for r in pieces(edge).collect())
    cut = {(r.doc_id, r.text) for r in lines(edge).collect()}
    assert (1, SENTENCE) in cut and (6, "") in cut and (None, "") in cut and (3, None) in cut and (7, "   \n\t ") in cut
    groups = by(near(edge), "class_id", "n_copies", "n_links")
    assert groups[(6, SENTENCE)] == (1, 4, 1) and groups[(12, SENTENCE + " again")] == (1, 1, 1) and groups[(3, None)] == (3, 1, 0)
    assert by(prints(edge), "f")[(2, "")] == ([],)
    kept = by(quality_perplexity.judged(edge).join(edge.select("doc_id", "text"), "doc_id"), "base_failed", "kept", "n_words")
    assert kept[(2, "")] == (True, False, 0) and kept[(1, SENTENCE)][0] is False
    assert by(passages(edge), "n_repeats", "n_repeated")[(4, LONG)][1] == 0


def test_mixed_documents_of_edge_rows(edge, nothing):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert source_mix.mixed_documents(nothing.select(*columns)).collect() == []
    found = source_mix.mixed_documents(edge.select(*columns)).collect()
    assert found and all(r.text.strip() and r.n_chars == len(r.text) for r in found)
