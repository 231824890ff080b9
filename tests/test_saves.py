"""Page tables in buckets, and saves that arrive as a stream, against plain models."""
import glob
import json
import os
import random
import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators import embedding
from folioscope.sources import index_table
from folioscope.sources.page_store import PageStore
from folioscope.streaming import backfill, saves as sv

KIND = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("item", T.StringType()), T.StructField("n", T.LongType())])


def files(root):
    return set(glob.glob(f"{root}/**/*.parquet", recursive=True))


def store(spark, tmp_path, **options):
    return PageStore(spark, str(tmp_path / "t"), KIND, "item", **options)


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_a_save_reads_and_writes_what_it_touches(spark, tmp_path):
    table = store(spark, tmp_path, buckets=6, keep=3)
    start = [(f"p{i:03d}", f"i{j}", i) for i in range(400) for j in range(3)]
    table.start(frame(spark, start))
    assert len(files(table.root)) == 6
    model = {}
    for p, i, n in start:
        model.setdefault(p, set()).add((p, i, n))
    rnd = random.Random(4)
    for version in range(1, 13):
        pages = rnd.sample(sorted(model), 2)
        rows = [(p, f"v{version}", k) for p in pages for k in range(rnd.randrange(3))]
        keys = frame(spark, [(p, "", 0) for p in pages])
        before = files(table.root)
        asked = table.read(keys)
        opened = {re.sub("^file:/+", "/", f) for f in asked.inputFiles()}
        assert content(asked) == sorted(r for p in pages for r in model[p])
        assert len(opened) <= 2 * (table.keep + 1)  # the two buckets, however many versions there are
        table.write(frame(spark, rows), keys, version)
        table.write(frame(spark, rows), keys, version)  # a retried batch
        for p in pages:
            model[p] = {r for r in rows if r[0] == p}
        assert 1 <= len(files(table.root) - before) <= 4  # one file per bucket, and one more where it is merged
    assert content(table.read()) == sorted(r for held in model.values() for r in held)
    assert content(table.read(below=1)) == sorted(start)
    assert all(len(p) <= table.keep + 1 for p in table.manifest()["buckets"].values())
    held = files(table.root)
    gone = table.vacuum(retain=2)
    assert content(table.read()) == sorted(r for rows in model.values() for r in rows)
    assert table.versions() == [11, 12] and len(gone) > 0 and files(table.root) < held
    assert table.vacuum(retain=2) == []


def test_an_unfinished_save_is_not_seen(spark, tmp_path):
    table = store(spark, tmp_path, buckets=4)
    assert table.read().collect() == [] and table.manifest()["buckets"] == {}
    keys = frame(spark, [("a", "", 0)])
    table.write(frame(spark, [("a", "x", 1)]), keys, 1)
    table._put(frame(spark, [("a", "y", 2)]).withColumn("_version", F.lit(2)), "data/version=2", 4)  # no manifest: the writer was lost
    assert content(table.read()) == [("a", "x", 1)]
    table.write(frame(spark, []), keys, 2)
    assert table.read().collect() == [] and content(table.read(below=2)) == [("a", "x", 1)]
    assert os.path.basename(files(f"{table.root}/data/version=2").pop()).startswith("part-")


def plain_marks(parts, previous):
    out = {}
    for part_id, text, confirmed, skipped in parts:
        old = previous.get(part_id)
        changed = old is not None and old[0] != text
        if not text.strip():
            out[part_id] = (text, False, False)
        elif confirmed:
            out[part_id] = (text, True, False)
        elif skipped and not changed:
            out[part_id] = (text, False, True)
        elif old is None:
            out[part_id] = (text, True, False)
        elif changed:
            out[part_id] = (text, False, False)
        else:
            out[part_id] = (text, old[1], old[2] and not old[1])
    return out


def test_random_saves_against_one_after_another(spark, tmp_path):
    """Several saves of a page in a batch, parts that go and come back, broken and late saves, pages nobody knows, a retry."""
    rnd = random.Random(9)
    pages = spark.createDataFrame([(f"p{i}", f"p{i}.jpg", 500, 500) for i in range(6)], "page_id string, filename string, width int, height int")
    stores = sv.SaveStores(spark, str(tmp_path), buckets=4, keep=2)
    first = {f"p{i}": {f"t{i}_{k}": ("velho", k == 1, k == 2) for k in range(4)} for i in range(6)}
    schema = sv.LINES
    stores.start(spark.createDataFrame([
        (p, f"{p}.jpg", f"l{p}", 0, 10, 10, 90, 40, True, [(t, *v) for t, v in parts.items()]) for p, parts in first.items()
    ], schema))
    state, last, refused = {p: dict(v) for p, v in first.items()}, {}, set()
    event = 0
    for batch_id in range(3):
        saves = []
        for _ in range(14):
            event += 1
            page = f"p{rnd.randrange(7)}"  # p6 is not known
            at = event if rnd.random() < 0.8 else max(1, event - 20)
            parts = [(f"t{page[1:]}_{k}", rnd.choice(["velho", "novo", " ", "outro"]), rnd.random() < 0.2, rnd.random() < 0.3) for k in rnd.sample(range(6), rnd.randrange(5))]
            fault = rnd.choice(["", "", "", "", "repeated", "json"])
            held = parts + parts[:1] if fault == "repeated" else parts
            body = "{not json" if fault == "json" else json.dumps({"lines": [
                {"id": f"l{page}", "box": [10, 10, 90, 40], "include": True, "parts": [dict(zip(("id", "text", "confirmed", "skipped"), x)) for x in held]}
            ], "more": 1})
            saves.append((page, body, at, event, parts, fault if not (fault == "repeated" and not parts) else ""))
        for page, _, at, number, parts, fault in sorted(saves, key=lambda s: (s[2], s[3])):
            if page == "p6":
                refused.add((page, number, "page"))
            elif fault:
                refused.add((page, number, "payload" if fault == "json" else "part"))
            elif page not in last or (at, number) > last[page]:
                state[page] = plain_marks(parts, state[page])
                last[page] = (at, number)
        # late against earlier batches only: inside a batch saves are put in order
        batch = spark.createDataFrame([(p, b, at, n) for p, b, at, n, _, _ in saves], "page_id string, payload string, at long, event_id long").select(
            "page_id", "payload", F.timestamp_seconds("at").alias("ts"), "event_id"
        )
        sv.apply_saves(stores, batch.unionByName(batch.limit(3)), batch_id, pages, F.timestamp_seconds(F.lit(0)))
        if batch_id == 1:
            sv.apply_saves(stores, batch, batch_id, pages, F.timestamp_seconds(F.lit(0)))
        got = {}
        for r in stores.lines.read().collect():
            got[r.page_id] = {p.part_id: (p.text, p.confirmed, p.skipped) for p in r.parts}
        # an included line without parts is given an empty one
        assert {p: {t: v for t, v in parts.items() if not t.startswith("pt_")} for p, parts in got.items()} == state
        index = {(r.page_id, r.part_id): (r.text, r.confirmed) for r in stores.index.read().collect()}
        assert index == {(p, t): (v[0].strip(), v[1]) for p in last for t, v in state[p].items() if v[0].strip()}
        assert {(r.page_id, r.event_id, r.kind) for r in stores.quarantine.read().collect()} == refused
    assert len(refused) > 4 and max(len(f) for f in stores.lines.manifest()["buckets"].values()) <= 3


def test_backfill_opens_the_buckets_of_its_batch(spark, tmp_path, monkeypatch):
    """Twelve batches: no vector is lost, and what a batch opens does not grow with the table."""
    opened = []

    def factory():
        def model(texts):
            return [[float(len(t)), 1.0] for t in texts]

        return model

    plain_read = PageStore.read

    def read(self, keys=None, below=None):
        found = plain_read(self, keys, below)
        if keys is not None:
            opened.append(sum(len(f) for f in self._folders(self.manifest(below), keys)))
        return found

    monkeypatch.setattr(PageStore, "read", read)
    want = {}
    for batch_id in range(12):
        rows = [(f"p{k}", f"h{k}_{batch_id if k % 4 == 0 else 0}", "x" * (k % 7 + 1)) for k in (batch_id * 2, batch_id * 2 + 1, batch_id)]
        want.update({r[:2]: [float(len(r[2])), 1.0] for r in rows})
        batch = spark.createDataFrame(rows + rows[:1], "part_id string, content_hash string, text string")
        for _ in range(1 + (batch_id == 3)):
            backfill.embed_batch(batch, batch_id, str(tmp_path / "v"), factory, 2)
    got = {(r.part_id, r.content_hash): list(r.embedding) for r in index_table.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert got == want
    assert max(opened[-6:]) <= 3 * 3


def test_saves_keep_long_texts_where_no_limit_is_set(spark, tmp_path):
    long = "á" * 20_500 + " fim"
    body = json.dumps({"lines": [{"id": "l1", "box": [10, 10, 90, 40], "include": True, "parts": [{"id": "t1", "text": long}]}]})
    batch = spark.createDataFrame([("p1", body, 5, 1)], "page_id string, payload string, at long, event_id long").select(
        "page_id", "payload", F.timestamp_seconds("at").alias("ts"), "event_id"
    )
    pages = spark.createDataFrame([("p1", 100, 100)], "page_id string, width int, height int")
    for name, limit, want in (("whole", {"max_chars": None}, long), ("cut", {}, long[:20_000])):
        stores = sv.SaveStores(spark, str(tmp_path / name), buckets=2)
        stores.start(spark.createDataFrame([], sv.LINES))
        sv.apply_saves(stores, batch, 0, pages, F.timestamp_seconds(F.lit(0)), **limit)
        assert [p.text for r in stores.lines.read().collect() for p in r.parts] == [want]
        assert [r.text for r in stores.index.read().collect()] == [want]


def test_hashed_vectors_are_made_once_and_not_checkpointed(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(backfill, "durable", lambda df, real=backfill.durable: made.append(df.columns) or real(df))
    for batch_id, rows_ in enumerate([[("a", "1", "um rio"), ("b", "1", "mar")], [("a", "2", "dois"), ("b", "1", "mar"), ("c", "1", "rio")]]):
        backfill.embed_batch(spark.createDataFrame(rows_, "part_id string, content_hash string, text string"), batch_id, str(tmp_path / "v"), None, 768)
    found = index_table.read_vectors(spark, str(tmp_path / "v")).collect()
    assert sorted((r.part_id, r.content_hash) for r in found) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
    assert all(len(r.embedding) == 768 for r in found) and not any("embedding" in c for c in made)


def test_backfilled_vectors_are_kept_and_moved_packed(spark, tmp_path, monkeypatch):
    """A first batch is stored once; the store holds words, not 768 values a text; what is read back are the vectors."""
    made = []
    monkeypatch.setattr(backfill, "durable", lambda df, real=backfill.durable: made.append(df.columns) or real(df))
    texts = [(f"p{i:03d}", "h", f"rio mar {i} rio" if i else "") for i in range(300)]
    batch = spark.createDataFrame(texts, "part_id string, content_hash string, text string")
    backfill.embed_batch(batch, 0, str(tmp_path / "v"), None, 768)
    assert len(made) == 1
    stored = index_table.read_packed(spark, str(tmp_path / "v"))
    assert stored.count() == 300 and stored.filter(F.length("embedding") > 100).isEmpty()
    wanted = {r.part_id: list(r.embedding) for r in embedding.embed_texts(batch).collect()}
    assert {r.part_id: list(r.embedding) for r in index_table.read_vectors(spark, str(tmp_path / "v")).collect()} == wanted
    table = batch.unionByName(spark.createDataFrame([("new", "h", "x"), ("p001", "other", "x")], batch.schema)).withColumn("embedding", F.lit(None).cast("array<float>"))
    for vectors in (stored, index_table.read_vectors(spark, str(tmp_path / "v"))):
        got = {(r.part_id, r.content_hash): r.embedding for r in index_table.with_vectors(table, vectors).collect()}
        assert got == {**{(p, "h"): v for p, v in wanted.items()}, ("new", "h"): None, ("p001", "other"): None}


def test_a_batch_of_saves_leaves_nothing_but_its_stores(spark, tmp_path):
    from folioscope.operators.spread import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names}
    line = {"id": "l1", "box": [10, 10, 90, 40], "include": True, "parts": [{"id": "t1", "text": "rio"}]}
    sent = [("p1", json.dumps({"lines": [line]}), 5, 1), ("p2", json.dumps({"lines": [{**line, "id": "l2"}]}), 5, 2)]
    emptied = [("p1", json.dumps({"lines": []}), 6, 3)]
    pages = spark.createDataFrame([("p1", 100, 100), ("p2", 100, 100)], "page_id string, width int, height int")
    stores = sv.SaveStores(spark, str(tmp_path / "s"), buckets=2)
    stores.start(spark.createDataFrame([], sv.LINES))
    before = files()
    for batch_id, rows_ in enumerate((sent, emptied)):
        batch = spark.createDataFrame(rows_, "page_id string, payload string, at long, event_id long").select(
            "page_id", "payload", F.timestamp_seconds("at").alias("ts"), "event_id"
        )
        sv.apply_saves(stores, batch, batch_id, pages, F.timestamp_seconds(F.lit(0)))
    assert files() == before
    assert [(r.page_id, r.line_id) for r in stores.lines.read().collect()] == [("p2", "l2")]
    assert [r.page_id for r in stores.index.read().collect()] == ["p2"]
