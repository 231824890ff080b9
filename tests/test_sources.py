import json

from pyspark.sql import functions as F

from folioscope.functions import boxes
from folioscope.functions.text import highlight, snippet, text_match
from folioscope.operators import edits, geometry, numbering, passages as px, review
from folioscope.schemas import TRANSCRIPTIONS
from folioscope.sources import exports, images, index_table, progress, session, versions
from folioscope.streaming import edits as streamed
from conftest import page, rows


def test_session_document_with_missing_fields(spark, tmp_path):
    document = {"pages": [{"id": "p001", "filename": "f.jpg", "width": 10, "height": 20, "lines": [
        {"id": "a", "box": [1, 2, 3, 4], "parts": [{"id": "x"}, {"id": "y", "text": "t", "confirmed": True, "skipped": True}]},
        {"id": "b", "box": [1, 2, 3, 4], "include": False},
    ]}]}
    path = tmp_path / "session.json"
    path.write_text(json.dumps(document, indent=2))
    pages, lines = session.load_session(spark, str(path), one_document=True)
    assert rows(pages, "page_id", "width") == [("p001", 10)]
    parts = numbering.part_rows(lines)
    assert rows(parts, "line_id", "include", "part_id", "text", "confirmed", "skipped") == [
        ("a", True, "x", "", False, False), ("a", True, "y", "t", True, False), ("b", False, None, "", False, False),
    ]


def test_snapshots_keep_order_and_the_newest_wins(spark, tmp_path):
    late = 1 << 40  # left-over lines of a second detection stand behind all others
    lines = page(spark, *[(f"n{i}", (i, i, i + 5, i + 5), True, [(f"q{i}", f"frase {i}")]) for i in range(1200)])
    lines = lines.withColumn("line_pos", F.col("line_pos").cast("bigint") + F.when(F.col("line_pos") % 3 == 0, F.lit(late)).otherwise(0))
    pages = spark.createDataFrame([("p001", "f.jpg", 100, 100), ("p002", "g.jpg", 100, 100)], "page_id string, filename string, width int, height int")
    session.save_session(pages, lines.limit(0), str(tmp_path / "s"), 1)
    session.save_session(pages, lines, str(tmp_path / "s"), 2)
    newest = session.latest_snapshot(spark, str(tmp_path / "s"))
    assert newest.endswith("version=2")
    found_pages, again = session.load_session(spark, newest)
    assert rows(found_pages, "page_id") == [("p001",), ("p002",)]
    expected = [r.line_id for r in lines.orderBy("line_pos").collect()]
    assert [(r.line_id, r.line_pos) for r in again.orderBy("line_pos").collect()] == [(x, i) for i, x in enumerate(expected)]


def test_short_boxes_are_refused_and_not_invented(spark):
    body = {"lines": [{"id": "a", "box": [1, 2, 3]}, {"id": "b", "box": [5, 5, 90, 20]}]}
    saves = spark.createDataFrame([("p001", json.dumps(body)), ("p002", json.dumps({"lines": body["lines"][1:]}))], "page_id string, payload string")
    lines = session.payload_lines(saves)
    pages = spark.createDataFrame([("p001", 1000, 1000), ("p002", 1000, 1000)], "page_id string, width int, height int")
    kept, bad = review.clean_lines(lines, pages)
    assert [(r.page_id, r.line_id, r.x0, r.y1) for r in kept.collect()] == [("p002", "b", 5, 20)]
    assert rows(bad, "page_id", "kind", "item_id", "reason") == [("p001", "box", "a", "box")]
    null = spark.createDataFrame([(None, 1, 50, 60)], "x0 int, y0 int, x1 int, y1 int")
    assert tuple(null.select(*boxes.named(boxes.clamp_box(boxes.corners(), F.lit(1000), F.lit(1000)))).first()) == (None,) * 4


def test_ids_end_where_they_end(spark):
    pages = spark.createDataFrame([("p001", 100, 100)], "page_id string, width int, height int")
    _, bad = review.clean_lines(page(spark, ("a\n", (0, 0, 50, 50), True, [("ok", "")])), pages)
    assert rows(bad, "kind", "item_id", "reason") == [("line", "a\n", "malformed")]


def test_splits_and_removals_in_log_order(spark):
    lines = page(spark, ("l", (0, 0, 50, 50), True, [("pa", "x")]))
    schema = "page_id string, line_id string, op string, part_id string, text string, new_id string, x0 double, y0 double, x1 double, y1 double, ts timestamp, event_id long"

    def after(*ops):
        log = [("p001", "l", op, part, None, new, None, None, None, None, None, i) for i, (op, part, new) in enumerate(ops)]
        log = spark.createDataFrame(log, schema).withColumn("ts", F.timestamp_seconds("event_id"))
        found = [[p.part_id for p in edits.apply_line_edits(lines, x).first().parts] for x in (log, edits.reduce_edits(log), edits.reduce_edits(log.unionByName(log)))]
        assert found[0] == found[1] == found[2]
        return found[0]

    split, remove = ("split", "pa", "x"), ("remove_part", "x", None)
    assert after(remove, split, remove) == ["pa"]
    assert after(split, remove, split) == ["pa", "x"]
    assert after(split, split) == ["pa", "x"]


def test_edit_payload_drops_unknown_fields(spark):
    body = {"lines": [{"id": "a", "box": [1.5, 2, 3, 4], "color": "red", "parts": [{"id": "x", "text": "t"}]}], "sensitivity": 0.5, "z": 1}
    saves = spark.createDataFrame([("p001", json.dumps(body))], "page_id string, payload string")
    found = session.payload_lines(saves).first()
    assert (found.line_id, found.x0, found.include, found.parts[0].part_id, found.parts[0].confirmed) == ("a", 1.5, True, "x", False)


def exported(lines, path):
    exports.write_text(lines, str(path))
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_text_export(spark, tmp_path):
    lines = page(
        spark, ("k", (5, 5, 90, 20), True, [("k1", "dez sacos"), ("k2", " de sal\r\ngrosso ")]), ("m", (5, 30, 90, 45), False, [("m1", "rabisco")]),
        ("n", (5, 60, 90, 75), True, [("n1", "total")]), ("o", (5, 90, 90, 99), False, [("o1", "")]),
    ).unionByName(page(spark, ("z", (5, 5, 90, 20), True, [("z1", "verso")]), page_id="p002"))
    pages = spark.createDataFrame([("p001", "rol.jpg"), ("p002", "rol2.jpg")], "page_id string, filename string")
    whole = exports.export_text(pages, numbering.number_parts(lines))
    assert exported(whole, tmp_path / "txt") == "\n".join([
        "T = linha transcrita. D = linha no documento.", "", "# rol.jpg", "[T001 | D001 parte 1] dez sacos", "[T002 | D001 parte 2] de sal / grosso",
        "[T003 | D003] total", "Fora da transcrição: D002, D004", "", "# rol2.jpg", "[T001 | D001] verso", "",
    ])
    assert "Nenhuma página importada." in exported(whole.limit(0), tmp_path / "none")


def test_long_lists_of_omitted_lines_are_one_line(spark, tmp_path):
    lines = page(spark, *[(f"l{i:04d}", (0, 20 * i, 9, 20 * i + 9), False, []) for i in range(2300)])
    pages = spark.createDataFrame([("p001", "folha.jpg")], "page_id string, filename string")
    text = exported(exports.export_text(pages, numbering.number_parts(lines)), tmp_path / "txt")
    assert text.splitlines()[3] == "Fora da transcrição: " + ", ".join(f"D{i:03d}" for i in range(1, 2301))


def test_page_documents(spark):
    lines = page(spark, ("k", (5, 5, 90, 20), True, [("k1", "dez"), ("k2", "onze")]), ("m", (5, 30, 90, 45), False, [("m1", "à margem"), ("m2", " "), ("m3", "fim")]))
    pages = spark.createDataFrame([("p001", "rol.jpg", 100, 80), ("p002", "nada.jpg", 10, 8)], "page_id string, filename string, width int, height int")
    found = {r.page_id: json.loads(r.json) for r in exports.export_pages(pages, numbering.number_parts(lines)).collect()}
    assert found["p002"] == {"arquivo": "nada.jpg", "largura": 10, "altura": 8, "linhas": [], "linhas_documento_sem_transcricao": []}
    first = found["p001"]
    assert (first["arquivo"], first["largura"], first["altura"]) == ("rol.jpg", 100, 80)
    assert [(x["linha_transcrita"], x["linha_documento"], x["parte"], x["texto"], x["caixa"]) for x in first["linhas"]] == [
        (1, 1, 1, "dez", [5, 5, 90, 20]), (2, 1, 2, "onze", [5, 5, 90, 20]),
    ]
    assert first["linhas_documento_sem_transcricao"] == [{"linha_documento": 2, "caixa": [5, 30, 90, 45], "texto_guardado": "à margem / fim"}]


def test_image_folder(spark, tmp_path):
    for name, data in (("a.JPG", b"x"), ("sub/b.png", b""), ("c.txt", b"x"), ("d.webp", b"yy")):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(data)
    listing = spark.createDataFrame([(f"file:{tmp_path}/sub/b.png", 0), (f"file:{tmp_path}/a.JPG", 1)], "path string, length long")
    found = images.ingest_images(images.read_files(spark, str(tmp_path), listing))
    assert rows(found, "filename", "length", "error") == [("a.JPG", 1, None), ("b.png", 0, "b.png: arquivo vazio"), ("d.webp", 2, None)]
    existing = spark.createDataFrame([("p001",), ("p003",)], "page_id string")
    placed = images.next_page_ids(existing, found.filter("error IS NULL").select("filename"), ["filename"])
    assert rows(placed, "filename", "page_id") == [("a.JPG", "p002"), ("d.webp", "p004")]
    summary = images.import_summary(found.withColumn("batch", F.lit("b")))
    assert rows(summary, "imported", "failed", "error") == [(2, 1, None)]


def test_progress_from_json_lines(spark, tmp_path):
    events = [{"seq": 1, "stage": "tile", "filename": "f", "done": 1, "total": 9}, {"seq": 3, "stage": "finished", "filename": "f"}, {"seq": 2, "stage": "tile", "filename": "f"}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, events)))
    found = progress.import_progress(progress.read_events(spark, str(tmp_path / "e.json"))).first()
    assert (found.seq, found.stage, found.message) == (3, "finished", "Melhorias concluídas · marcando as linhas…")


def test_page_versions(spark, tmp_path):
    schema = "page_id string, item string"
    root = str(tmp_path / "t")

    def frame(*data):
        return spark.createDataFrame(list(data), schema)

    versions.write_all(frame(("p1", "a"), ("p2", "b"), ("p3", "c")), root, 0)
    versions.write_pages(frame(("p1", "a2")), frame(("p1", ""), ("p2", "")), root, 1)
    kind = frame(("", "")).schema
    assert rows(versions.read_pages(spark, root, kind, "item"), "page_id", "item") == [("p1", "a2"), ("p3", "c")]
    assert rows(versions.read_pages(spark, root, kind, "item", below=1), "item") == [("a",), ("b",), ("c",)]
    versions.write_pages(frame(("p1", "a3")), frame(("p1", "")), root, 1)  # a retried batch
    assert rows(versions.read_pages(spark, root, kind, "item", pages=frame(("p1", ""))), "item") == [("a3",)]


def test_streamed_edits_keep_the_index_in_step(spark, tiny, tmp_path):
    from folioscope.operators import edits
    from folioscope.plans import desk, review_queries

    now = F.timestamp_seconds(F.lit(1_700_000_000))
    stores = streamed.EditStores(str(tmp_path))
    lines = desk.lines(spark, tiny).filter("page_id < 'p000040'").cache()
    stores.start(lines)
    log = review_queries.line_edits(spark, tiny).filter("page_id < 'p000040'").select(*streamed.LINE_EDITS.fieldNames()).cache()
    streamed.apply_batch(stores, log.filter("event_id > 3"), 0, now)
    streamed.apply_batch(stores, log.filter("event_id <= 3"), 1, now)
    streamed.apply_batch(stores, log.filter("event_id <= 3"), 1, now)  # again, as after a failure
    expected = px.passages(numbering.number_parts(edits.apply_line_edits(lines, log)))
    touched = log.select("page_id").distinct()
    expected = expected.join(touched, "page_id", "left_semi")
    columns = ("page_id", "part_id", "linha_documento", "linha_transcrita", "text", "content_hash", "confirmed")
    assert rows(index_table.read_table(spark, stores.index), *columns) == rows(expected, *columns)


def test_edited_pages_are_read_in_their_buckets(spark, tiny, tmp_path):
    from folioscope.operators import edits
    from folioscope.plans import desk, review_queries

    stores = streamed.EditStores(str(tmp_path))
    lines = desk.lines(spark, tiny).filter("page_id < 'p000040'").cache()
    stores.start(lines)
    log = review_queries.line_edits(spark, tiny).filter("page_id < 'p000020'").select(*streamed.LINE_EDITS.fieldNames()).cache()
    streamed.apply_batch(stores, log.filter("event_id > 3"), 0, F.current_timestamp())
    streamed.apply_batch(stores, log.filter("event_id <= 3"), 1, F.current_timestamp())
    current = stores.current_lines(spark)
    assert "hashpartitioning" not in current._jdf.queryExecution().executedPlan().toString()
    expected = edits.apply_line_edits(lines, log)
    assert rows(current, "page_id", "line_id", "x0", "y0", "include", "parts") == rows(expected, "page_id", "line_id", "x0", "y0", "include", "parts")


def test_saved_pages_keep_ids_and_vectors(spark):
    blank = {f.name: None for f in TRANSCRIPTIONS.fields}

    def old(i, page_id, part_id, text_hash):
        return tuple({**blank, "id": i, "page_id": page_id, "part_id": part_id, "content_hash": text_hash, "embedding": [1.0]}.values())

    stored = spark.createDataFrame([old(1, "p1", "a", "h"), old(2, "p1", "b", "h"), old(3, "p1", "c", "h"), old(4, "p2", "d", "h")], TRANSCRIPTIONS)
    current = spark.createDataFrame(
        [("p1", "n", "l", "a", 1, 1, "t", "h", False), ("p1", "n", "l", "b", 1, 1, "t", "new", False), ("p2", "n", "l", "c", 1, 1, "t", "h", False), ("p2", "n", "l", "e", 1, 1, "t", "h", True)],
        "page_id string, page_name string, line_id string, part_id string, linha_documento int, linha_transcrita int, text string, content_hash string, confirmed boolean",
    )
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    pages = spark.createDataFrame([("p1",), ("p2",)], "page_id string")
    names = TRANSCRIPTIONS.fieldNames()
    assert rows(px.index_saved(stored, current, now).select(*names), *names) == rows(px.index_upsert(stored, current, pages, now), *names)


def test_a_part_that_moves_is_written_and_not_deleted(spark):
    blank = {f.name: None for f in TRANSCRIPTIONS.fields}
    stored = spark.createDataFrame(
        [tuple({**blank, "page_id": "p1", "part_id": "a", "text": "t", "content_hash": "h", "embedding": [1.0]}.values())], TRANSCRIPTIONS
    )
    passage = spark.createDataFrame(
        [("p2", "n", "l", "a", 1, 1, "t", "h", False)],
        "page_id string, page_name string, line_id string, part_id string, linha_documento int, linha_transcrita int, text string, content_hash string, confirmed boolean",
    )
    now = F.current_timestamp()
    moved = px.index_upsert(stored, passage, spark.createDataFrame([("p2",)], "page_id string"), now)
    assert rows(moved, "page_id", "part_id", "embedding") == [("p2", "a", None)]
    left = px.index_upsert(moved, passage.limit(0), spark.createDataFrame([("p1",)], "page_id string"), now)
    assert rows(left, "page_id", "part_id") == [("p2", "a")]


def test_gutters_of_given_boxes(spark):
    side = [(20, y, 150, y + 20) for y in (20, 50, 90)] + [(250, y, 380, y + 20) for y in (20, 50, 90)] + [(10, 128, 360, 160)]
    book = page(spark, *[(f"l{i}", b, True, []) for i, b in enumerate(side)])
    single = page(spark, *[(f"l{i}", b, True, []) for i, b in enumerate([(20, 20, 210, 40), (20, 50, 210, 70), (20, 90, 210, 110), (20, 120, 210, 145)])], page_id="p002")
    pages = spark.createDataFrame([("p001", 420, 220), ("p002", 420, 220)], "page_id string, width int, height int")
    found = geometry.page_gutters(book.unionByName(single), pages).collect()
    assert [r.page_id for r in found] == ["p001"]
    assert 140 <= found[0].gutter_start <= 200 <= found[0].gutter_end <= 260


def test_search_text(spark):
    df = spark.createDataFrame([("Pagou a sáca de trigo",)], "t string")
    t = F.col("t")
    assert df.filter(text_match(t, "SACA")).count() == 1
    assert df.filter(text_match(t, "trigo pagou")).count() == 1
    assert df.filter(text_match(t, "t")).count() == 0
    assert df.select(highlight(t, "saca")).first()[0] == "Pagou a <mark>sáca</mark> de trigo"
    long = spark.createDataFrame([("x" * 100 + " alvo " + "y" * 200,)], "t string")
    cut = long.select(snippet(t, "alvo")).first()[0]
    assert cut.startswith("…x") and cut.endswith("y…") and len(cut) == 182


def test_ids_fill_holes_without_listing_numbers(spark):
    import random

    from folioscope.sources import images

    rnd = random.Random(2)
    for case in range(4):
        used = {1_000_000_000, *rnd.sample(range(1, 60), 30)} if case else set()
        if case == 2:
            used |= set(range(1, 40)) - {7}
        wanted = [5, 70, 9000, 1][case]
        existing = spark.createDataFrame([(f"p{n:03d}",) for n in used] + [("p7x",), ("p0012",), ("p000",)], "page_id string")
        new = spark.range(wanted).select(F.format_string("f%06d", "id").alias("filename"))
        got = [r.page_id for r in images.next_page_ids(existing, new, ["filename"]).orderBy("filename").collect()]
        free = (n for n in range(1, 20_000) if n not in used)
        assert got == [f"p{next(free):03d}" for _ in range(wanted)]
