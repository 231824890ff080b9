"""Personal data in texts: e-mail and IP addresses, card and phone numbers.

Plain rules find the base spans. A linear-chain conditional random field over word-shape features adds what the rules
miss: numbers written in other ways, or run together with their neighbours. It is trained by maximum likelihood from a small
labelled table: at most `per_kind` base matches of every kind with the text around them (those of smallest hash, so the
choice does not depend on how rows are dealt out), the same with the match rewritten by rules (VARIANTS), and as many
places without a match, also with look-alikes (DECOYS) put in. Decoding is Viterbi in numpy batches, over every stretch of
text around a digit, an @ or an opening bracket: a span of any kind has one of them. A decoded span is added if it
overlaps no base span and holds what its kind must hold (for a card, 16 to 19 digits that pass Luhn).

Defined results: null and empty texts have no span. Offsets count code points. Repeated rows get equal results, whatever their
neighbours. Without any base match in the corpus there is no model and nothing is added. An empty table gives no rows.
Columns are kept, but for one named `pii`. Very long texts are scanned in time that grows with their length.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import linear_crf
from folioscope.llm.arrays import slices
from folioscope.llm.store import stored

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
PER_KIND = 100
AROUND = 50  # code points on each side of a labelled match
REACH = 40  # and of a digit, @ or bracket that is decoded

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits fails where the run's start fails, so runs are tried once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
SIGNAL = re.compile(r"[0-9@\[(]")
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-zÀ-ɏ0-9]")


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_SIGNS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    out = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(is_octet, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and passes_luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span can be: around every signal, joined where they meet, ends moved to white space close by."""
    out: list[list[int]] = []
    for m in SIGNAL.finditer(text):
        if out and m.start() - REACH <= out[-1][1]:
            out[-1][1] = m.end() + REACH
        else:
            out.append([m.start() - REACH, m.end() + REACH])
    found = []
    for start, stop in out:
        start, stop = max(0, start), min(len(text), stop)
        if start:
            space = text.find(" ", start, start + REACH // 2)
            start = space + 1 if space >= 0 else start
        if stop < len(text):
            space = text.rfind(" ", stop - REACH // 2, stop)
            stop = space if space >= 0 else stop
        found.append((start, stop))
    return found


def shape(token: str) -> str:
    if token[0] in "0123456789":
        return f"d{min(len(token), 20)}"
    if not token[0].isalpha():
        return token if token < "\x80" else "sign"
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[0].isupper() and token[1:].islower() else "aA"
    return f"{case}{len(token) if len(token) < 4 else 4 if len(token) < 9 else 9}"


def features(text: str, start: int, stop: int) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Token offsets of a stretch, and the features of every token: shapes of words, never the words, but for those up to three letters."""
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, stop)]
    tokens = [text[a:b] for a, b in found]
    shapes = ["<", "<", *map(shape, tokens), ">", ">"]
    glued = [False, *(found[i][0] == found[i - 1][1] for i in range(1, len(found))), False]
    group: dict[int, str] = {}  # token to size and check digit of the digits it is written together with
    at = 0
    while at < len(tokens):
        last, digits = at, tokens[at] if shapes[at + 2][0] == "d" else ""
        if digits:
            while last + 1 < len(tokens):
                here = found[last][1]
                step = 1 if shapes[last + 3][0] == "d" and found[last + 1][0] - here == 1 else 2 if (
                    tokens[last + 1] == "-" and last + 2 < len(tokens) and shapes[last + 4][0] == "d" and found[last + 2][0] - here == 1) else 0
                if not step or len(digits) > 40:
                    break
                last += step
                digits += tokens[last]
            name = f"{min(len(digits), 24)}{passes_luhn(digits) if 15 < len(digits) < 20 else ''}"
            for i in range(at, last + 1):
                group[i] = name
        at = last + 1
    rows = []
    for i, token in enumerate(tokens):
        before2, before, own, after, after2 = shapes[i : i + 5]
        left, right = "~" if glued[i] else " ", "~" if glued[i + 1] else " "
        check = ""
        if own[0] == "d":
            check = str(is_octet(token)) if len(token) < 4 else str(passes_luhn(token)) if 15 < len(token) < 20 else ""
        rows.append([
            "", f"0{own}", f"-{before}", f"+{after}", f"--{before2}", f"++{after2}", f"g{left}{own}{right}", f"p{before}{left}{own}", f"n{own}{right}{after}",
            f"t{before}{left}{own}{right}{after}", f"b{before2}|{before}{left}{own}", f"f{own}{right}{after}|{after2}", f"c{own}{check}",
            f"u{group.get(i, '')}", f"ug{group.get(i - 1, '')}|{group.get(i, '')}", f"w{token.lower()}" if len(token) <= 3 and token.isalpha() else "w",
        ])
    return found, rows


WIDTH = 16


def variants(kind: str, core: str) -> list[tuple[list[tuple[str, str]], ...]]:
    """Other ways to write a match: lists of (kind or '', piece)."""
    digits = NOT_DIGIT.sub("", core)
    own = lambda *pieces: [[(kind, p)] for p in pieces]
    if kind == "email":
        name, _, host = core.partition("@")
        dots = host.replace(".", " [dot] ")
        return own(f"{name} [at] {host}", f"{name}[at]{host}", f"{name} (at) {host}", f"{name}(at){host}", f"{name}(at){dots}", f"{name} @ {host}", f"{name} [at] {dots}", f"{name}@{host.split('.')[0]}")
    if kind == "ip":
        parts = core.split(".")
        return own("[.]".join(parts), ".".join(parts) + ".", " . ".join(parts)) + [[(kind, core), ("", f":{8000 + int(parts[-1])}")]]
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        other = digits[4:8] + digits[:4] + digits[8:]
        both = [[(kind, core), ("", " "), (kind, digits)], [(kind, core), ("", "-"), (kind, core)]]
        swapped = [[(kind, core), ("", " "), (kind, other)]] if passes_luhn(other) else []
        return own(".".join(fours), " ".join(fours), "-".join(fours), "/".join(fours)) + both + swapped + [[("", "12 "), (kind, core)], [(kind, core), ("", " 340")]]
    last = digits[-10:]
    if len(last) < 10:
        return []
    a, b, c = last[:3], last[3:6], last[6:]
    return own(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}", f"+ 1 {a} {b} {c}") + [
        [(kind, core), ("", " "), ("card", card)] for card in (f"4{last}0000{k}" for k in range(10)) if passes_luhn(card) and len(card) == 16
    ]


def decoys(kind: str, core: str) -> list[str]:
    """Look-alikes that are no personal data, made of the digits of a match."""
    digits = (NOT_DIGIT.sub("", core) * 8 + "20481632641282565121")[:40]
    day, month, year = int(digits[:2]) % 28 + 1, int(digits[2:4]) % 12 + 1, 1900 + int(digits[4:7]) % 130
    wrong = next(digits[:15] + str(k) for k in range(10) if not passes_luhn(digits[:15] + str(k)))
    return [
        f"{year}-{month:02d}-{day:02d}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{day % 24}:{month:02d}:{day:02d}", f"{digits[:1]},{digits[1:4]}.{digits[4:6]}",
        f"{digits[:1]}.{digits[1:2]}.{digits[2:3]}", f"{digits[:1]}.{digits[1:2]}.", wrong, f"{int(digits[:6]):040x}"[-20:] + digits[:5], f"{year}-{year + 3}",
        f"({digits[:3]})", f"[{digits[:2]}]", digits[:7], digits[:10], f"{digits[:4]} {digits[4:6]}", f"{300 + int(digits[:2])}.{digits[2:5]}.9.{digits[5:9]}", f"@{'abcdefgh'[int(digits[0]) % 6:]}",
        f"{digits[:3]} {digits[3:6]} {digits[6:9]}", f"AK{digits[:2]}IA{digits[2:5]}Q", f"\"{digits[:3]}e{digits[3:7]}f{digits[7:9]}\"", f"{digits[:24]}",
    ]


def labelled_table(docs: DataFrame, per_kind: int = PER_KIND, text: str = "text") -> DataFrame:
    """kind ('' for none), before, core, after: at most `per_kind` places of every kind, those of smallest hash."""

    def run(batches):
        held: dict[str, dict] = {kind: {} for kind in ("", *KINDS)}
        for batch in batches:
            for value in batch.column(0):
                value = value.as_py()
                if not value or not SIGNAL.search(value):
                    continue
                spans = base_spans(value)
                places = spans or [("", a, a) for a, _ in stretches(value)[:1]]
                for kind, start, stop in places:
                    row = (value[max(0, start - AROUND) : start], value[start:stop], value[stop : stop + AROUND + 40 * (not kind)])
                    held[kind][zlib.crc32("\0".join(row).encode("utf-8", "surrogatepass")), *row] = None
            for rows in held.values():
                for row in sorted(rows)[per_kind:]:
                    del rows[row]
        out = [(kind, *row) for kind, rows in held.items() for row in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.string()) for i in (2, 3, 4))],
            ["kind", "rank", "before", "core", "after"],
        )

    found = stored(docs.select(text).mapInArrow(run, "kind string, rank long, before string, core string, after string"), "labelled")
    chosen = [found.filter(F.col("kind") == kind).distinct().orderBy("rank", "before", "core", "after").limit(per_kind) for kind in ("", *KINDS)]
    table = chosen[0]
    for more in chosen[1:]:
        table = table.unionByName(more)
    return table.select("kind", "before", "core", "after")


def sentences(rows: list) -> Iterator[tuple[str, list[Span]]]:
    """Labelled texts of the labelled table: as they are, rewritten, and with look-alikes."""
    for number, (kind, before, core, after) in enumerate(rows):
        cores = [[(kind, core)]] + (variants(kind, core) if kind else [])
        if kind:
            looks = decoys(kind, core)
            cores += [[("", looks[(number + k) % len(looks)])] for k in range(3)]
        for pieces in cores:
            text, spans = before, base_spans(before)
            for piece_kind, piece in pieces:
                if piece_kind:
                    spans.append((piece_kind, len(text), len(text) + len(piece)))
                text += piece
            spans += [(k, a + len(text), b + len(text)) for k, a, b in base_spans(after)]
            yield text + after, spans


class Tagger:
    """A trained model with its feature numbers; travels to tasks as it is (a few hundred kB)."""

    def __init__(self, numbers: dict[str, int], model: linear_crf.Model):
        self.numbers, self.model = numbers, model

    def ids(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([[self.numbers.get(f, -1) for f in row] for row in rows], dtype=np.int64).reshape(-1, WIDTH)

    def tag(self, texts: list[str]) -> list[list[Span]]:
        """Decoded spans of every text."""
        found: list[list[Span]] = [[] for _ in texts]
        held, ids, sizes = [], [], []

        def flush():
            if held:
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                tags = linear_crf.decode(self.model, np.concatenate(ids), bounds).tolist()
                for (number, offsets), lo in zip(held, bounds.tolist(), strict=False):
                    found[number] += labelled_spans(offsets, tags[lo : lo + len(offsets)])
            held.clear(), ids.clear(), sizes.clear()

        for number, text in enumerate(texts):
            for start, stop in stretches(text) if text else ():
                offsets, rows = features(text, start, stop)
                if offsets:
                    held.append((number, offsets))
                    ids.append(self.ids(rows))
                    sizes.append(len(offsets))
                    if sum(sizes) > 50_000:
                        flush()
        flush()
        return found


def labelled_spans(offsets: list[tuple[int, int]], tags: list[int]) -> list[Span]:
    """Spans of labels: 0 is none, then two per kind, first token and others."""
    out: list[Span] = []
    open_kind = None
    for (start, stop), tag in zip(offsets, tags, strict=True):
        kind = KINDS[(tag - 1) // 2] if tag else None
        if kind and tag % 2 == 0 and kind == open_kind:
            out[-1] = (kind, out[-1][1], stop)
        elif kind:
            out.append((kind, start, stop))
        open_kind = kind
    return out


def token_labels(offsets: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    labels = [0] * len(offsets)
    for kind, start, stop in spans:
        inside = [i for i, (a, b) in enumerate(offsets) if a >= start and b <= stop]
        for i in inside:
            labels[i] = 2 + 2 * KINDS.index(kind)
        if inside:
            labels[inside[0]] -= 1
    return labels


def fit(docs: DataFrame, per_kind: int = PER_KIND, text: str = "text", rounds: int = 40) -> Tagger | None:
    """The tagger learned from the labelled table of `docs` (at most 5 * per_kind rows reach the driver)."""
    return fit_rows([tuple(r) for r in labelled_table(docs, per_kind, text).collect()], rounds)


def fit_rows(rows: list, rounds: int = 40) -> Tagger | None:
    rows = sorted(rows)
    if not any(kind for kind, *_ in rows):
        return None
    numbers: dict[str, int] = {}
    ids, gold, sizes = [], [], []
    for text, spans in sentences(rows):
        for start, stop in stretches(text):
            offsets, found = features(text, start, stop)
            if offsets:
                ids += [[numbers.setdefault(f, len(numbers)) for f in row] for row in found]
                gold += token_labels(offsets, spans)
                sizes.append(len(offsets))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Tagger(numbers, linear_crf.train(np.array(ids), bounds, np.array(gold), len(numbers), 1 + 2 * len(KINDS), rounds=rounds))


def holds_its_kind(kind: str, piece: str) -> bool:
    digits = NOT_DIGIT.sub("", piece)
    if kind == "card":
        return 16 <= len(digits) <= 19 and passes_luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        parts = [p for p in NOT_DIGIT.split(piece) if p]
        return len(parts) == 4 and all(map(is_octet, parts))
    return bool(re.search(r"[A-Za-z0-9].*(@|\bat\b).*[A-Za-z0-9]", piece))


def all_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of every text, by kind, then start."""
    decoded = tagger.tag(texts) if tagger else [[] for _ in texts]
    out = []
    for text, more in zip(texts, decoded, strict=True):
        base = base_spans(text) if text else []
        taken = sorted((a, b) for _, a, b in base)
        spans = [(*s, True) for s in base]
        for kind, a, b in more:
            if holds_its_kind(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
                spans.append((kind, a, b, False))
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
    return out


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """The rows of `docs` with pii: kind, start, stop (exclusive, code points) and whether the plain rules found it."""
    docs = docs.drop("pii")
    kept, names = docs.schema.fields, docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for start, stop, _, _ in slices(column):
                texts = [t or "" for t in column.slice(start, stop - start).to_pylist()]
                found = [[dict(zip(("kind", "start", "stop", "base"), s, strict=True)) for s in spans] for spans in all_spans(texts, shared.value)]
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, pa.array(found, kind_of)], [*names, "pii"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "pii array<struct<kind:string,start:int,stop:int,base:boolean>>"
    return docs.select(*names).mapInArrow(run, schema)


def masked(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `find` with every span of the text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))

    def step(state, span):
        gap = F.substring(F.col(text), state["at"] + 1, span["start"] - state["at"])
        piece = F.concat(state["out"], gap, F.lit("<"), span["kind"], F.lit(">"))
        return F.when(span["start"] < state["at"], state).otherwise(F.struct(piece.alias("out"), span["stop"].alias("at")))

    def finish(state):
        return F.concat(state["out"], F.substring(F.col(text), state["at"] + 1, F.length(text)))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return rows.withColumn(text, F.aggregate(ordered, begin, step, finish))
