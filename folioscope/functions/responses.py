"""Model answers and error texts as columns; malformed input gives null, never an exception."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import once, strip

# Answers that mean "no text", line ends, error wordings, pauses in seconds.
NO_TEXT = ("[sem texto]", "sem texto")
LINE_END = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RUNNER_ERRORS = ("model runner", "llama-server", "unexpected eof", "status code: 500", "server closed")
BUSY_ERRORS = ("http 429", "http 500", "http 502", "http 503", "rate limit", "overloaded")
TIMEOUT_ERRORS = ("timeout", "timed out")
RETRY_CLASSES = ("jsondecodeerror", "responseerror")
EMPTY_ANSWER = "resposta vazia"
PAUSES = {"runner": 45.0, "timeout": 20.0, "retry": 2.0}


def clean_reading(text: Column) -> Column:
    cleaned = strip(text)
    return F.when(F.lower(cleaned).isin(*NO_TEXT), "").otherwise(cleaned)


def after_think(text: Column) -> Column:
    """What follows the first closing thought tag; nothing when a thought never closes."""

    def answer(t: Column) -> Column:
        closing = F.regexp_instr(t, F.lit("(?i)</think>"))
        return (
            F.when(closing > 0, strip(F.substring(t, closing + 8, F.length(t))))
            .when(F.lower(t).contains("<think>"), "")
            .otherwise(strip(t))
        )

    return once(text, answer)


def json_object(text: Column) -> Column:
    """The JSON object in an answer, as text: fences off, from the first brace to the last; null if it does not parse."""

    def unfenced(t: Column) -> Column:
        inner = strip(F.regexp_replace(strip(F.regexp_replace(t, "^(?i)```(?:json)?", "")), "```$", ""))
        return F.when(t.startswith("```"), inner).otherwise(t)

    def cut(t: Column) -> Column:
        start = F.instr(t, "{")
        end = F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((start > 0) & t.contains("}") & (end >= start), F.substring(t, start, end - start + 1))

    trimmed = once(strip(text), unfenced)
    return once(once(trimmed, cut), lambda t: F.when(F.try_parse_json(t).isNotNull(), t))


def _kind(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID"))


def _string(variant: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(variant, path, "string"), F.lit(""))


def _item_text(item: Column) -> Column:
    as_object = F.coalesce(_string(item, "$.texto"), _string(item, "$.text"), F.lit(""))
    return F.when(_kind(item).startswith("OBJECT"), as_object).otherwise(
        F.coalesce(F.try_variant_get(item, "$", "string"), F.lit(""))
    )


def _lines(text: Column) -> Column:
    """Lines without a trailing empty one."""
    pieces = F.split(text, LINE_END)
    last = F.element_at(pieces, -1)
    return F.when(last == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def response_texts(answer: Column, expected: Column) -> Column:
    """Exactly `expected` texts from {"linhas": [...]}: cleaned, padded with empty ones or cut."""
    empty = F.array().cast("array<string>")

    def raw(linhas: Column) -> Column:
        kind = _kind(linhas)
        return (
            F.when(kind == "STRING", once(F.try_variant_get(linhas, "$", "string"), _lines))
            .when(kind.startswith("ARRAY"), F.transform(F.try_variant_get(linhas, "$", "array<variant>"), _item_text))
            .otherwise(empty)
        )

    def unpacked(texts: Column) -> Column:
        only = F.get(texts, F.lit(0))
        one_block = (F.size(texts) == 1) & (expected > 1) & only.contains("\n")
        return F.when(one_block, F.transform(once(only, _lines), clean_reading)).otherwise(texts)

    listed = once(F.try_variant_get(F.try_parse_json(answer), "$.linhas", "variant"), raw)
    texts = once(F.transform(F.coalesce(listed, empty), clean_reading), unpacked)
    return F.slice(F.concat(texts, F.array_repeat(F.lit(""), expected)), F.lit(1), expected)


def openai_content(payload: Column) -> Column:
    """Text of a chat payload: a string, a list of parts, or else the reasoning behind its thought; null without a choice."""

    def part(p: Column) -> Column:
        path_text = F.when(_kind(p).startswith("OBJECT"), F.try_variant_get(p, "$.text", "string"))
        return F.coalesce(path_text.otherwise(F.try_variant_get(p, "$", "string")), F.lit(""))

    def joined(content: Column) -> Column:
        parts = F.array_join(F.transform(F.try_variant_get(content, "$", "array<variant>"), part), "")
        whole = F.try_variant_get(content, "$", "string")
        return strip(F.coalesce(F.when(_kind(content).startswith("ARRAY"), parts).otherwise(whole), F.lit("")))

    def text(choice: Column) -> Column:
        content = once(F.try_variant_get(choice, "$.message.content", "variant"), joined)
        reasoning = after_think(F.coalesce(F.try_variant_get(choice, "$.message.reasoning", "string"), F.lit("")))
        found = once(content, lambda t: F.when(t == "", reasoning).otherwise(t))
        return F.when(_kind(choice).startswith("OBJECT"), found)

    return once(F.try_variant_get(F.try_parse_json(payload), "$.choices[0]", "variant"), text)


def failure_kind(error_class: Column, message: Column) -> Column:
    """runner, timeout, retry, or the empty string for failures that are final."""
    name = F.lower(error_class)
    full = F.lower(F.concat_ws(" ", error_class, message))

    def any_of(words) -> Column:
        found = F.lit(False)
        for word in words:
            found = found | full.contains(word)
        return found

    return (
        F.when(any_of(RUNNER_ERRORS), "runner")
        .when(any_of(BUSY_ERRORS + TIMEOUT_ERRORS), "timeout")
        .when(name.isin(*RETRY_CLASSES) | full.contains(EMPTY_ANSWER), "retry")
        .otherwise("")
    )


def failure_kind_of(error: BaseException) -> str:
    """The same for an exception inside a task."""
    name, full = type(error).__name__.lower(), f"{type(error).__name__} {error}".lower()
    kinds = {"runner": RUNNER_ERRORS, "timeout": BUSY_ERRORS + TIMEOUT_ERRORS}
    found = [kind for kind, words in kinds.items() if any(word in full for word in words)]
    return (found or ["retry" if name in RETRY_CLASSES or EMPTY_ANSWER in full else ""])[0]


def failure_pause(kind: Column) -> Column:
    pause = F.lit(0.0)
    for name, seconds in PAUSES.items():
        pause = F.when(kind == name, seconds).otherwise(pause)
    return pause


def parse_embeddings(payload: Column, expected: Column, width: int) -> tuple[Column, Column]:
    """(vectors, error): vectors in request order, null with a reason when the answer does not fit the request."""
    parsed = F.try_parse_json(payload)
    many = F.try_variant_get(parsed, "$.embeddings", "array<array<double>>")
    single = F.try_variant_get(parsed, "$.embedding", "array<double>")
    data = F.try_variant_get(parsed, "$.data", "array<struct<index:int,embedding:array<double>>>")
    # Equal indexes keep the order they came in.
    tagged = F.transform(data, lambda d, i: F.struct(F.coalesce(d["index"], F.lit(0)).alias("at"), i.alias("i"), d["embedding"].alias("embedding")))
    by_index = F.transform(F.array_sort(tagged), lambda d: d["embedding"])
    vectors = F.coalesce(many, F.when(single.isNotNull(), F.array(single)), by_index)
    error = (
        F.when(vectors.isNull() | (F.size(vectors) != expected), "count")
        .when(F.exists(vectors, lambda v: v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull())), "invalid")
        .when(F.exists(vectors, lambda v: F.size(v) != width), "size")
    )
    return F.when(error.isNull(), vectors), error


