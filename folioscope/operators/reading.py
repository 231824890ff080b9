"""Batch reading: read groups, prompts, the model call, written texts, outcomes."""
from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import responses as rs
from folioscope.operators.spread import durable
from folioscope.settings import GROUP_MAX_HEIGHT, GROUP_MAX_LINES

# Wording of the prompt and of progress messages.
PROMPT_HEAD = "Esta imagem é um recorte de manuscrito com {count} {noun} de escrita, de cima para baixo.{apart}\n"
PROMPT_APART = " Cada linha está isolada, com uma faixa clara entre uma e outra."
PROMPT_RULES = (
    "Transcreva cada linha na mesma ordem.\n"
    "Preserve a grafia original, abreviações, acentos, números e traços.\n"
    "Não modernize, não explique, não traduza e não invente.\n"
    "Se um trecho não puder ser lido, use [ilegível].\n"
    "Se a linha não tiver escrita, use [sem texto].\n"
    "Responda somente JSON:\n"
)
PROMPT_COLUMNS = "\nA página tem dois textos lado a lado. Transcreva só o texto desta faixa, sem a coluna vizinha."
PROMPT_FORMS = "\nFormas já conferidas neste acervo, que podem reaparecer: "
PROMPT_NEIGHBOURS = "\nNesta leitura há trechos [ilegível]. Linhas já conferidas com fraseado parecido:\n"
PROMPT_NEIGHBOURS_END = (
    "\nUse essas linhas só como precedente de grafia e fórmula. "
    "Se a imagem não sustentar a palavra, mantenha [ilegível]."
)
DONE = "Transcrição pronta."
PARTIAL = "Leitura parcial. "
NOTHING_TO_READ = "Nenhuma linha vazia para ler."
NO_JSON = "A resposta não trouxe JSON."

_GROUP = "page_id string, linha_documento int, group_no int"


def read_groups(pending: DataFrame, max_height: int = GROUP_MAX_HEIGHT, max_lines: int = GROUP_MAX_LINES) -> DataFrame:
    """(page_id, linha_documento, group_no) for pending lines: batches of neighbouring lines, by a fold in D order."""
    per_page = pending.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("linha_documento", "y0", "y1"))).alias("_ls")
    )
    start = F.struct(
        F.lit(0).alias("top"), F.lit(0).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("i"),
        F.array().cast("array<int>").alias("starts"),
    )

    def step(acc: Column, line: Column) -> Column:
        opens = (
            (acc["n"] == 0) | (line["y0"] < acc["last"]) | (line["y1"] - acc["top"] > max_height) | (acc["n"] >= max_lines)
        )
        return F.struct(
            F.when(opens, line["y0"]).otherwise(acc["top"]).alias("top"),
            line["y0"].alias("last"),
            F.when(opens, 1).otherwise(acc["n"] + 1).alias("n"),
            (acc["i"] + 1).alias("i"),
            F.when(opens, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]).alias("starts"),
        )

    starts = F.aggregate("_ls", start, step, lambda acc: acc["starts"])
    groups = per_page.withColumn("_starts", starts).select(
        "page_id", "_ls", "_starts", F.posexplode("_starts").alias("_g", "_from")
    )
    until = F.coalesce(F.get("_starts", F.col("_g") + 1), F.size("_ls"))
    return groups.select(
        "page_id", (F.col("_g") + 1).alias("group_no"),
        F.explode(F.slice("_ls", F.col("_from") + 1, until - F.col("_from"))).alias("_l"),
    ).select("page_id", F.col("_l.linha_documento").alias("linha_documento"), "group_no")


def group_spans(groups: DataFrame) -> DataFrame:
    """D-003 a D-010 and "k of n" per group."""
    spans = groups.groupBy("page_id", "group_no").agg(
        F.min("linha_documento").alias("first"), F.max("linha_documento").alias("last"), F.count("*").alias("lines")
    )
    totals = groups.groupBy("page_id").agg(F.max("group_no").alias("groups"))
    first, last = F.format_string("D-%03d", F.col("first")), F.format_string("D-%03d", F.col("last"))
    span = F.when(F.col("first") == F.col("last"), first).otherwise(F.concat(first, F.lit(" a "), last))
    return spans.join(totals, "page_id").select(
        "page_id", "group_no", "groups", "lines", span.alias("span"),
        F.concat(F.lit("Lendo "), span, F.format_string(" (%d de %d)", F.col("group_no"), F.col("groups"))).alias("message"),
    )


def prompt(lines: Column, two_columns: Column, forms: Column, neighbours: Column) -> Column:
    """The request for one read group; `forms` and `neighbours` are arrays, empty or null where there are none."""

    def has(values: Column) -> Column:
        return F.coalesce(F.size(values), F.lit(0)) > 0

    head, rest = PROMPT_HEAD.split("{count}")
    middle, tail = rest.split("{noun}")
    after_noun = tail.split("{apart}")
    return F.concat(
        F.lit(head), lines.cast("string"), F.lit(middle), F.when(lines == 1, "linha").otherwise("linhas"), F.lit(after_noun[0]),
        F.when(lines > 1, PROMPT_APART).otherwise(""), F.lit(after_noun[1]), F.lit(PROMPT_RULES),
        F.lit('{"linhas":['), F.array_join(F.array_repeat(F.lit('"..."'), lines.cast("int")), ", "), F.lit("]}"),
        F.when(F.coalesce(two_columns, F.lit(False)), PROMPT_COLUMNS).otherwise(""),
        F.when(has(forms), F.concat(F.lit(PROMPT_FORMS), F.array_join(forms, ", "), F.lit("."))).otherwise(""),
        F.when(
            has(neighbours),
            F.concat(
                F.lit(PROMPT_NEIGHBOURS), F.array_join(F.transform(neighbours, lambda n: F.concat(F.lit("- "), n)), "\n"),
                F.lit(PROMPT_NEIGHBOURS_END),
            ),
        ).otherwise(""),
    )


def build_prompts(
    groups: DataFrame, gutters: DataFrame | None = None, forms: list[str] | None = None, precedents: DataFrame | None = None
) -> DataFrame:
    """(page_id, group_no, lines, prompt). precedents: page_id, group_no, neighbours."""
    per_group = groups.groupBy("page_id", "group_no").agg(F.count("*").cast("int").alias("lines"))
    if gutters is not None:
        per_group = per_group.join(gutters.select("page_id", F.lit(True).alias("_two")), "page_id", "left")
    else:
        per_group = per_group.withColumn("_two", F.lit(False))
    if precedents is not None:
        per_group = per_group.join(precedents, ["page_id", "group_no"], "left")
    else:
        per_group = per_group.withColumn("neighbours", F.array().cast("array<string>"))
    words = F.array(*[F.lit(w) for w in (forms or [])]).cast("array<string>")
    return per_group.select(
        "page_id", "group_no", "lines", prompt(F.col("lines"), F.col("_two"), words, F.col("neighbours")).alias("prompt")
    )


MOST_TASKS = 8

Ask = Callable[[str, dict], str]
Wait = Callable[[float], None]


def _ask_once(requests: DataFrame, ask_factory: Callable[[], Ask]) -> DataFrame:
    """One call per request; adds answer, or failure and its kind ('' when it is final)."""
    added = [T.StructField(name, T.StringType()) for name in ("answer", "failure", "kind")]
    schema = T.StructType([*requests.schema.fields, *added])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = ask_factory()
        for frame in batches:
            found = []
            for row in frame.to_dict("records"):
                try:
                    found.append((ask(row["prompt"], row), None, None))
                except Exception as exc:  # a failed group is a row, the others go on
                    found.append((None, str(exc) or exc.__class__.__name__, rs.failure_kind_of(exc)))
            answers, failures, kinds = zip(*found, strict=True) if found else ((), (), ())
            yield frame.assign(answer=list(answers), failure=list(failures), kind=list(kinds))

    return requests.mapInPandas(call, schema)


def _dealt(requests: DataFrame, per_task: int) -> DataFrame:
    """Requests spread evenly over tasks, by hash of the group, `per_task` or so in each and at least a task per core.

    A core gets MOST_TASKS at most: with more requests tasks are longer and not more, since a round's tasks are the partitions
    of all later steps.
    """
    cores = requests.sparkSession.sparkContext.defaultParallelism
    return requests.repartition(max(cores, min(-(-requests.count() // per_task), MOST_TASKS * cores)), "page_id", "group_no")


def ask_groups(
    requests: DataFrame, ask_factory: Callable[[], Ask], attempts: int = 2, wait: Wait = time.sleep, per_task: int = 64
) -> DataFrame:
    """Model answers per request; adds answer, or failure when every call raised.

    The factory runs once per task. `ask(prompt, row)` gets the other columns as a dict and
    returns the raw answer. Calls go in rounds. A round's results are written to the checkpoint folder, so later rounds
    and stages never ask again what is answered, whatever executors are lost meanwhile. Failures that may pass make the
    next round: those of one kind are asked together after the kind's pause, which the driver waits once per round,
    counted from the round's end. No task ever waits. `attempts` calls in all; tables may be empty.
    """
    left = durable(requests)
    finished: list[DataFrame] = []
    for attempt in range(attempts):
        if attempt == 0:
            rounds = [durable(_ask_once(_dealt(left, per_task), ask_factory))]
        else:
            waited, rounds = 0.0, []
            for kind in kinds:
                wait(max(0.0, rs.PAUSES[kind] - waited))
                waited = max(waited, rs.PAUSES[kind])
                again = left.filter(F.col("kind") == kind).drop("answer", "failure", "kind")
                rounds.append(durable(_ask_once(_dealt(again, per_task), ask_factory)))
        asked = reduce(DataFrame.unionByName, rounds)
        may_pass = F.coalesce(F.col("kind"), F.lit("")) != ""
        if attempt + 1 == attempts:
            finished.append(asked)
            break
        kinds = sorted((r["kind"] for r in asked.filter(may_pass).select("kind").distinct().collect()), key=rs.PAUSES.get)  # three kinds at most
        if not kinds:
            finished.append(asked)
            break
        finished.append(asked.filter(~may_pass))
        left = asked.filter(may_pass)
    return reduce(DataFrame.unionByName, finished).drop("kind")


def parsed_answers(answered: DataFrame) -> DataFrame:
    """Adds texts (one per line of the group) and turns unreadable answers into failures."""
    found = rs.json_object(rs.after_think(F.coalesce("answer", F.lit(""))))
    held = answered.withColumn("_json", found)
    failure = F.when(F.col("failure").isNotNull(), F.col("failure")).when(
        F.col("_json").isNull(), NO_JSON
    )
    texts = F.when(F.col("_json").isNotNull(), rs.response_texts(F.col("_json"), F.col("lines")))
    return held.withColumns({"failure": failure, "texts": texts}).drop("_json")


def line_readings(groups: DataFrame, answered: DataFrame) -> DataFrame:
    """(page_id, group_no, position, linha_documento, text) of the groups that were read."""
    order = W.partitionBy("page_id", "group_no").orderBy("linha_documento")
    placed = groups.withColumn("position", F.row_number().over(order) - 1)
    texts = answered.filter("texts IS NOT NULL").select(
        "page_id", "group_no", F.posexplode("texts").alias("position", "text")
    )
    return placed.join(texts, ["page_id", "group_no", "position"]).select(
        "page_id", "group_no", "position", "linha_documento", "text"
    )


def reading_outcome(results: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per page: groups, failures, status and message. results: page_id, group_no, span, failure (null when read).
    Those of `pages` without a group had nothing to read."""
    failed = F.col("failure").isNotNull()
    first = F.min_by(
        F.concat(F.col("span"), F.lit(": "), F.col("failure")), F.when(failed, F.col("group_no"))
    )
    counts = results.groupBy("page_id").agg(
        F.count("*").alias("groups"), F.count_if(failed).alias("failures"), first.alias("_first")
    )
    status = (
        F.when((F.col("failures") > 0) & (F.col("failures") == F.col("groups")), "error")
        .when(F.col("failures") > 0, "partial")
        .otherwise("done")
    )
    message = (
        F.when(status == "error", F.col("_first"))
        .when(status == "partial", F.concat(F.lit(PARTIAL), F.col("_first")))
        .otherwise(DONE)
    )
    read = counts.select("page_id", "groups", "failures", status.alias("status"), message.alias("message"))
    if pages is None:
        return read
    none = F.lit(0).cast("bigint")
    idle = pages.select("page_id").join(read, "page_id", "left_anti").select(
        "page_id", none.alias("groups"), none.alias("failures"), F.lit("done").alias("status"), F.lit(NOTHING_TO_READ).alias("message")
    )
    return read.unionByName(idle)
