"""Quality rules: counts over words, and perplexity bands per language from a Kneser-Ney model of the corpus.

A document's perplexity is taken per character under the model of its own language (null: a language of its
own). Log-perplexities of short texts scatter, so each is drawn towards the language's median as if it had
PRIOR_CHARS more characters of that perplexity. The band of a language runs from FENCE quartile ranges below its
first quartile to as many above its third; documents outside are rejected. Texts without a character have no
perplexity and fail the base rule. Bands and counts come from all rows. Repeated rows count each; an empty table gives no
rows. Columns are kept, but for those named like a count or a result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm import kneser_ney
from folioscope.llm.arrays import SEPARATOR, code_points, mix, per_text, runs, slices, span_hash, windows, words
from folioscope.llm.store import stored

PRIOR_CHARS = 300
GROUP_BYTES = 32_000_000
FENCE = 3.0
REPEAT_WINDOW = 5
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal another of the same text, and which equal an earlier one."""
    key = mix(hashes ^ mix(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), dtype=bool)
    shared = np.zeros(len(key), dtype=bool)
    again[order[1:][same]] = True
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return shared, again


def word_counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    texts = len(offs) - 1
    starts, ends, of = words(data, offs)
    points = np.concatenate(([0], np.cumsum(code_points(data))))
    out = {"n_words": np.bincount(of, minlength=texts).astype(np.int64)}
    out["word_chars"] = per_text(points[ends] - points[starts], of, texts)
    signs = np.concatenate(([0], np.cumsum(SYMBOL[data])))
    out["n_symbols"] = signs[offs[1:]] - signs[offs[:-1]]
    line_start, line_end = runs(data != 0x0A, offs)
    filled = np.concatenate(([0], np.cumsum(~SEPARATOR[data])))
    has_word = filled[line_end] > filled[line_start]
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_of = np.searchsorted(offs[1:], line_start, side="right")
    out["n_dup_lines"] = per_text(repeated(span_hash(data, line_start, line_end), line_of)[1], line_of, texts)
    shingle, first = windows(span_hash(data, starts, ends), of, REPEAT_WINDOW)
    shared, _ = repeated(shingle, of[first])
    cover = np.zeros(len(of) + 1, dtype=np.int64)
    np.add.at(cover, first[shared], 1)
    np.add.at(cover, first[shared] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = per_text(np.cumsum(cover)[:-1] > 0, of, texts)
    return out


def measured(docs: DataFrame, model: kneser_ney.Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the counts, the number of characters scored (n_scored) and the mean negative log-probability (nll)."""
    added = {**{c: "bigint" for c in COUNTS}, "n_scored": "bigint", "nll": "double"}
    kept = [f for f in docs.schema if f.name not in added]
    names = [f.name for f in kept if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept if f.name != text] + [f"{c} {t}" for c, t in added.items()])

    def symbols(batch):
        keys = np.array([kneser_ney.language_key(x) for x in batch.column(batch.schema.get_field_index(lang)).to_pylist()], dtype=np.int64)
        for start, stop, data, offs in slices(batch.column(batch.schema.get_field_index(text))):
            yield data, offs, (*kneser_ney.symbols(data, offs), keys[start:stop])

    def groups(batches):
        group, size = [], 0
        for batch in batches:
            group.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if size > GROUP_BYTES:
                yield group
                group, size = [], 0
        if group:
            yield group

    def measure(batches):
        for group in groups(batches):
            # the model's parts are read once for all texts of a group
            scores = model.scores(x for batch in group for _, _, x in symbols(batch))
            for batch in group:
                found: dict[str, list] = {c: [] for c in added}
                for data, offs, (points, begins, keys) in symbols(batch):
                    for c, values in word_counts(data, offs).items():
                        found[c].append(values)
                    logp = scores.log_probabilities(points, begins, keys)
                    sums = np.concatenate(([0.0], np.cumsum(logp, dtype=np.float64)))
                    n = np.diff(begins)
                    found["n_scored"].append(n)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        found["nll"].append(np.where(n > 0, -(sums[begins[1:]] - sums[begins[:-1]]) / np.maximum(n, 1), np.nan))
                arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
                for c, kind in added.items():
                    values = np.concatenate(found[c]) if found[c] else np.zeros(0)
                    arrays.append(pa.array(values, pa.float64(), from_pandas=True) if kind == "double" else pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    return docs.select(*[f.name for f in kept]).mapInArrow(measure, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bands(rows: DataFrame, lang: str = "lang") -> DataFrame:
    """Per language: median, and the lower and upper bound of the adjusted mean negative log-probability."""
    medians = rows.groupBy(lang).agg(F.percentile_approx("nll", 0.5, 10000).alias("median_nll"))
    adjusted = rows.join(F.broadcast(medians), rows[lang].eqNullSafe(medians[lang])).drop(medians[lang])
    adjusted = adjusted.withColumn("nll_adjusted", adjusted_nll())
    quarters = adjusted.groupBy(lang).agg(
        F.percentile_approx("nll_adjusted", [0.25, 0.75], 10000).alias("_q"), F.first("median_nll").alias("median_nll")
    )
    spread = F.col("_q")[1] - F.col("_q")[0]
    return quarters.select(
        F.col(lang).alias("_lang"), "median_nll",
        (F.col("_q")[0] - FENCE * spread).alias("nll_low"), (F.col("_q")[1] + FENCE * spread).alias("nll_high"),
    )


def adjusted_nll() -> Column:
    n = F.col("n_scored")
    return (F.col("nll") * n + F.col("median_nll") * PRIOR_CHARS) / (n + PRIOR_CHARS)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", model: kneser_ney.Model | None = None) -> DataFrame:
    """All columns but the text, with counts, perplexity, the band of the language, base_failed and kept."""
    model = model or kneser_ney.fit(docs, text, lang)
    rows = stored(measured(docs, model, text, lang), "quality-counts")
    limits = bands(rows, lang)
    placed = rows.join(F.broadcast(limits), F.col(lang).eqNullSafe(F.col("_lang")), "left").drop("_lang")
    placed = placed.withColumn("nll_adjusted", adjusted_nll()).withColumn("base_failed", base_failed())
    inside = F.coalesce((F.col("nll_adjusted") >= F.col("nll_low")) & (F.col("nll_adjusted") <= F.col("nll_high")), F.lit(False))
    return placed.withColumn("perplexity", F.exp("nll")).withColumn("kept", ~F.col("base_failed") & inside)
