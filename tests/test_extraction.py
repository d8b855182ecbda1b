"""The whole pipeline on a synthetic document, its sources and its files."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import hierarchy
from quillstream.plans import extraction
from quillstream.sources import tables


def span(text, x, y, bold=False, font=None, flags=0):
    return (text, font or ("Arial-Bold" if bold else "Arial"), flags, [float(x), float(y), float(x + 6 * len(text)), float(y + 10)])


def line(*spans):
    boxes = [s[3] for s in spans]
    return ([min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)], list(spans))


def grid(x, y, n, step, w):
    """n horizontal lines and four upright ones."""
    down = step * (n - 1)
    return [("l", [x, y + step * k, x + w, y + step * k]) for k in range(n)] + [("l", [x + w * k / 3, y, x + w * k / 3, y + down]) for k in range(4)]


def page(doc, no, lines, drawings=(), images=(), height=800.0):
    items = [(op, [float(v) for v in p]) for op, p in drawings]
    return (doc, no, height, [(0, list(lines)), (1, [line(span("imagen", 0, 0))])], [(items,)], [([[float(v) for v in r]],) for r in images])


HEAD = "Encabezado repetido"


def document(doc):
    head = line(span(HEAD, 0, 10))
    one = [
        head, line(span("5. Antes de todo", 0, 40)), line(span("I. Descripción", 0, 100, True)), line(span("del proyecto", 0, 112, True)), line(span("Sub uno", 0, 150, True)),
        line(span("1. Primera pregunta con", 0, 180)), line(span("continua-", 0, 195)), line(span("ción. Sub dos", 0, 210)), line(span("Celda", 20, 320)), line(span("Sub dos", 0, 700, font="Arial", flags=16)), line(span("Firmado Digitalmente por X", 0, 760)),
    ]
    two = [head, line(span("2.", 0, 60), span("Segunda", 20, 60)), line(span("12", 0, 790)), line(span("3. Tercera", 0, 400)), line(span("II. Vacío", 0, 500, True)), line(span("lejos", 0, 560, True))]
    three = [head, line(span("9. Dentro", 50, 120)), line(span("4. Cuarta  x   y", 0, 600))]
    return [
        page(doc, 1, one, grid(10, 300, 8, 30.0, 150.0), [(300, 300, 400, 400), (500, 300, 600, 400), (0, 0, 10, 10)]),
        page(doc, 2, two, grid(10, 620, 6, 10.0, 150.0)),
        page(doc, 3, three, [], [(40, 100, 200, 200)]),
    ]


@pytest.fixture(scope="module")
def got(spark):
    rows = document("a") + document("b") + [("vacío", 1, 800.0, None, None, None), ("vacío", 2, None, [], [], [])]
    return extraction.extract(spark.createDataFrame(rows, tables.PAGE))


def test_scans(spark):
    pages = spark.createDataFrame(document("a"), tables.PAGE)
    spans = tables.text_spans(pages).where("page_no = 1").orderBy("seq").collect()
    assert [s.text for s in spans if s.is_bold] == ["I. Descripción", "del proyecto", "Sub uno", "Sub dos"] and "imagen" not in {s.text for s in spans}
    assert [r.text for r in tables.text_lines(pages).where("page_no = 2").orderBy("seq").collect()][1] == "2.Segunda"
    assert tables.drawing_items(pages).count() == 22 and tables.placements(pages).count() == 4


def test_regions(got, spark):
    rows = extraction.regions(spark.createDataFrame(document("a"), tables.PAGE)).collect()
    found = sorted((r.page_no, r.tipo, r.x0, r.y0, r.x1, r.y1) for r in rows)
    # The second page's table is too small.
    assert found == [(1, "figura", 300.0, 300.0, 400.0, 400.0), (1, "figura", 500.0, 300.0, 600.0, 400.0), (1, "tabla", 10.0, 300.0, 160.0, 510.0), (3, "figura", 40.0, 100.0, 200.0, 200.0)]


def test_texts_lose_headers_noise_and_regions(got):
    texts = {r.doc_id: r.text for r in got.texts.collect()}
    assert set(texts) == {"a", "b"} and texts["a"] == texts["b"]
    assert texts["a"].split("\n") == [
        "5. Antes de todo", "I. Descripción", "del proyecto", "Sub uno", "1. Primera pregunta con", "continua-", "ción. Sub dos", "Sub dos", "2.Segunda", "3. Tercera", "II. Vacío", "lejos", "4. Cuarta  x   y",
    ]


def test_hierarchy(got):
    chapters = {r.doc_id: r.chapters for r in got.chapters.collect()}
    assert set(chapters) == {"a", "b"}
    one, two = chapters["a"]
    # Numbers below the 5 before the chapter are out of order, so only the 5 stays; a chapter without questions stays.
    assert (one.text, one.page, one.questions, one.questions_without_hinge) == ("I. Descripción del proyecto", 1, [], [])
    assert [(h.text, h.page, h.questions) for h in one.hinges] == [("Sub uno", 1, []), ("Sub dos", 1, [])]
    assert (two.text, two.hinges, two.questions) == ("II. Vacío", [], []) and one.bbox == [0.0, 100.0, 84.0, 122.0]


def test_questions(got):
    rows = got.questions.where("doc_id = 'b'").orderBy("seq").collect()
    # 1 falls by 4 and stays, 3 and 4 follow; "2.Segunda" has no space.
    assert [(r.numero, r.capitulo, r.bisagra) for r in rows] == [(5, "", None), (1, "", None), (3, "", None), (4, "", None)]
    assert rows[0].texto == "Antes de todo I. Descripción del proyecto Sub uno" [: len("Antes de todo I. Descripción del proyecto")].strip()  # the hinge at the end goes
    assert rows[1].texto == "Primera pregunta con continuación. Sub dos Sub dos 2.Segunda" and rows[3].texto == "Cuarta;x;y"
    parts = [[tuple(p) for p in r.tablas_figuras] for r in rows]
    assert parts[0] == [("figura", 1, "p005_parte001_figura.png"), ("figura", 2, "p005_parte002_figura.png"), ("figura", 3, "p005_parte003_figura.png"), ("tabla", 1, "p005_parte001_tabla.png")] and parts[1:] == [[], [], []]


def test_summary(got):
    rows = {r.doc_id: tuple(r)[1:] for r in got.summary.collect()}
    assert rows == {"a": (3, 2, 2, 4, 1, 3, 4), "b": (3, 2, 2, 4, 1, 3, 4), "vacío": (2, 0, 0, 0, 0, 0, 0)}


def test_far_figures_are_numbered_in_reverse(got):
    figures = got.detections.where("doc_id = 'a' and tipo = 'figura' and page_no = 1").orderBy("parte").collect()
    assert [r.x0 for r in figures] == [500.0, 300.0]


def test_questions_below_chapters_and_hinges(spark):
    rows = [line(span("II. Uno", 0, 50, True)), line(span("1. a", 0, 90)), line(span("Sub", 0, 140, True)), line(span("2. b", 0, 170)), line(span("2. c", 0, 190)), line(span("III. Dos", 0, 300, True)), line(span("2. d", 0, 330)), line(span("0. cero", 0, 400))]
    got = extraction.extract(spark.createDataFrame([page("d", 1, rows, images=[(300, 0, 400, 100), (300, 340, 400, 440)])], tables.PAGE))
    chapters = got.chapters.first().chapters
    assert [(c.text, c.questions, c.questions_without_hinge, [(h.text, h.questions) for h in c.hinges]) for c in chapters] == [("II. Uno", [1, 2, 2], [1], [("Sub", [2, 2])]), ("III. Dos", [2], [2], [])]
    assert [(r.numero, r.capitulo, r.bisagra, r.texto) for r in got.questions.orderBy("seq").collect()] == [(1, "II. Uno", None, "a"), (2, "III. Dos", None, "b"), (2, "III. Dos", None, "c III. Dos"), (2, "III. Dos", None, "d"), (0, "", None, "cero")]
    labels = {(r.pregunta, r.png) for r in got.detections.collect()}
    assert (None, "p000_parte001_figura.png") in labels and (2, "p002_parte001_figura.png") in labels


def test_no_pages(spark):
    got = extraction.extract(spark.createDataFrame([], tables.PAGE))
    assert [df.count() for df in (got.questions, got.detections, got.chapters, got.texts, got.summary)] == [0] * 5


def test_lookup_takes_the_last_chapter_and_those_without_hinge(spark):
    rows = [(1, "chapter", "I", None), (2, "question", "", 7), (3, "hinge", "h", None), (4, "question", "", 7), (5, "question", "", 8), (6, "chapter", "II", None), (7, "hinge", "k", None), (8, "question", "", 8)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, at int, kind string, text string, num int")
    got = {r.num: (r.capitulo, r.bisagra) for r in hierarchy.lookup(hierarchy.timeline(df, ["doc"], ["at"]), ["doc"], ["at"]).collect()}
    assert got == {7: ("I", None), 8: ("II", "k")}


def test_files(spark, tmp_path):
    tax = {"A": {"nombre": "Uno", "keywords": ["pregunta", "tercera"]}, "B": {"nombre": "Dos", "keywords": ["nada"]}}
    (tmp_path / "tax.json").write_text(json.dumps(tax))
    taxonomy = tables.taxonomy_json(spark, str(tmp_path / "tax.json"))
    assert taxonomy.count() == 3
    extraction.process(spark.createDataFrame(document("a"), tables.PAGE), str(tmp_path / "out"), taxonomy)
    files = {p.name: "".join(f.read_text() for f in p.glob("part-*")) for p in (tmp_path / "out" / "doc_id=a").iterdir()}
    assert set(files) == {f"name={n}" for n in ("preguntas.json", "preguntas.txt", "chapters_hinges.json", "texto_total.txt", "preguntas_clasificadas.json", "preguntas_clasificadas_detalle.json")}
    asked = json.loads(files["name=preguntas.json"])
    assert [q["numero"] for q in asked] == [5, 1, 3, 4] and list(asked[0]) == ["capitulo", "bisagra", "numero", "texto", "tablas_figuras"] and asked[0]["bisagra"] is None
    assert len(json.loads(files["name=chapters_hinges.json"])["chapters"]) == 2
    assert files["name=preguntas.txt"].startswith("------------\nNUMERO: 5\nAntes de todo") and files["name=preguntas.txt"].rstrip("\n").endswith("\n------------")
    detail = json.loads(files["name=preguntas_clasificadas_detalle.json"])
    assert len(detail) == 4 and set(detail[0]) == {"numero", "capitulo", "bisagra", "tema_principal", "tema_principal_id", "temas_principales", "temas_principales_id", "temas"}
    (tmp_path / "in" / "d1").mkdir(parents=True)
    (tmp_path / "in" / "d1" / "preguntas.json").write_text(files["name=preguntas.json"])
    back = tables.questions_json(spark, str(tmp_path / "in" / "*" / "preguntas.json")).orderBy("seq").collect()
    assert [(r.doc_id, r.seq, r.numero) for r in back] == [("d1", 0, 5), ("d1", 1, 1), ("d1", 2, 3), ("d1", 3, 4)] and back[0].tablas_figuras[0].tipo == "figura"
    with pytest.raises(Exception):
        tables.questions_json(spark, str(tmp_path / "missing")).count()


def test_arrival(spark, tmp_path):
    from quillstream.streaming.ingest import ingest

    schema = tables.PAGE
    spark.createDataFrame(document("a"), schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(tmp_path / "in"), schema, lambda b: b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "n").collect()] == [("a", 3)]


def test_pdf_files_need_the_optional_package(spark):
    with pytest.raises(ImportError, match="pymupdf"):
        tables.pdf_pages(spark, "/nowhere")
