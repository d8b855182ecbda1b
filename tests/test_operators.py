import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.functions import text
from quillstream.operators import classify, hierarchy, layout, lines, questions
from quillstream.plans import catalog


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r


def test_strip_knows_python_white_space(spark):
    s = " \u0085\x1c　 a b \t\n"
    assert one(spark, s, text.strip) == s.strip()


def test_whole_words_by_unicode_borders(spark):
    assert " co₂ " in one(spark, "co₂ emitido", text.as_words)
    assert " so2 " not in one(spark, "so2₂", text.as_words)


def test_paragraph_marks(spark):
    assert one(spark, "A\n\nB", text.paragraphs) == "A \n B"
    assert one(spark, "evalua-\nción", text.paragraphs) == "evaluación"


def test_signature_and_trailing_hinge(spark):
    assert one(spark, "Texto.\nFirmado Digitalmente por Ana Paz\n3 de mayo de 2024.", text.without_signature) == "Texto."
    assert one(spark, " Texto.\n", text.without_signature) == " Texto."
    cut = lambda t, *hs: one(spark, t, lambda c: text.without_trailing(c, F.array(*map(F.lit, hs)).cast("array<string>")))
    assert cut("Texto Anexo A", "Anexo A.") == "Texto"
    assert cut("Texto Anexo A", "Anexo A.", "xo A") == "Texto"  # both forms of a hinge before the next hinge
    assert cut("Texto Anexo A \n", " Anexo A ") == "Texto" and cut("Texto \n") == "Texto" and cut("Texto", "", " ", "x") == "Texto"


def test_blank_line_defeats_the_year_test():
    assert questions.segments("a\n2024.\nb") == []
    assert [n for n, _ in questions.segments("a\n\n2024.\nb")] == [2024]
    assert [n for n, _ in questions.segments("10. a\n6. b\n5. c\n1. d\n2. e")] == [10, 6, 5, 1, 2][:2] + [5, 1, 2]


def test_frequent_lines_need_two_pages(spark):
    one_page = spark.createDataFrame([("d", 1, "h")], "doc string, page int, text string")
    assert lines.frequent_lines(lines.page_lines(one_page, ["doc", "page"]), "doc", "page").count() == 0
    seven = spark.createDataFrame([("d", p, "h\nx" + str(p) if p < 4 else "") for p in range(7)], "doc string, page int, text string")
    assert [r.line for r in lines.frequent_lines(lines.page_lines(seven, ["doc", "page"]), "doc", "page").collect()] == ["h"]


def test_monotonic_filter(spark):
    df = spark.createDataFrame([([10, 6, 5, 1, 2],)], "a array<int>").select(hierarchy.monotonic(F.col("a")).alias("r"))
    assert df.first().r == [10, 6, 5, 1, 2]
    df = spark.createDataFrame([([10, 5, 7, 2],)], "a array<int>").select(hierarchy.monotonic(F.col("a")).alias("r"))
    assert df.first().r == [10, 7]


def test_far_rects_come_back_reversed():
    a, b = (0, 0, 10, 10), (100, 100, 110, 110)
    assert layout.close_rects([a, b], 10) == [b, a]
    assert layout.close_rects([a, (15, 0, 20, 10)], 10) == [(0, 0, 20, 10)]


def test_repeated_entries_count_and_ties_keep_order(spark):
    tax = spark.createDataFrame([(0, "A", "a", 0, "ruido"), (0, "A", "a", 1, "ruido"), (1, "B", "b", 0, "ruido"), (1, "B", "b", 1, "ruidos")], "topic_pos int, topic_id string, topic_name string, kw_pos int, keyword string")
    q = spark.createDataFrame([(1, "", None, "Ruidos fuertes"), (2, "", None, "nada")], "id int, chapter string, hinge string, text string")
    rows = {r.id: r for r in classify.classify(q, tax, "id").collect()}
    assert rows[1].temas_principales == ["a", "b"] and rows[1].score == 2.0
    assert rows[2].tema_principal_id == "SIN_CLASIFICAR" and rows[2].score == 0.0


def test_question_segments_whatever_a_text_begins_with(spark, tmp_path):
    texts = ["Abc\nd", "Élan\nb\n", "Ñu", "12 a", "¿Que?", "", None]
    rows = [(i * 11 + 8, t) for i, t in enumerate(texts)]  # first lines get a number
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in catalog.question_segments(spark, str(tmp_path)).collect()}
    assert got == {i for i, t in rows if t is not None}


def test_table_gate_and_areas(spark):
    def page(n, n_h, n_v, w):
        return [(n, k, "h", w, 30.0 * k, 0.0, 30.0 * k) for k in range(n_h)] + [(n, 50 + k, "v", w / max(1, n_v - 1) * k, 0.0, w / max(1, n_v - 1) * k, 150.0) for k in range(n_v)]

    rows = page(1, 6, 4, 100.0) + page(2, 5, 4, 100.0) + page(3, 6, 3, 100.0) + page(4, 6, 4, 99.0)
    seg = spark.createDataFrame(rows, "page int, seq int, kind string, x1 double, y1 double, x2 double, y2 double")
    assert [r.page for r in layout.table_pages(seg, ["page"]).collect()] == [1]
    # Nearest lines are over 24 apart only down the page; the vertical ones touch all of them.
    assert [tuple(r)[2:] for r in layout.table_regions(seg, ["page"]).collect()] == [(0.0, 0.0, 100.0, 150.0)]
    img = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 80.0), (1, 1, 105.0, 0.0, 205.0, 80.0), (1, 2, 210.0, 0.0, 300.0, 80.0)], "page int, seq int, x0 double, y0 double, x1 double, y1 double")
    assert [tuple(r)[2:] for r in layout.figure_regions(img, ["page"]).collect()] == [(0.0, 0.0, 205.0, 80.0)]


def test_chapters_starts_and_hinges(spark):
    texts = [" XIV. Título", "c. x", "IV.Sin", "IV. ", "12. a", "12.a", "12345. a", "7. "]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in df.where(layout.is_chapter(F.col("text"))).collect()] == texts[:2]
    assert [r.num for r in layout.question_starts(df).collect()] == [12, 7]
    at = [(1, 100.0, "near"), (1, 84.9, "far"), (1, 100.0, "II. Cap"), (1, 680.0, "foot"), (1, 679.9, "high"), (2, 680.0, "last")]
    blocks = spark.createDataFrame([("d", p, t, 0.0, y - 9, 9.0, y) for p, y, t in at], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    starts = spark.createDataFrame([("d", 1, 155.0), ("d", 1, 140.0), ("d", 1, 90.0), ("d", 2, 250.0), ("d", 3, 250.1)], "doc string, page int, y0 double")
    pages = spark.createDataFrame([("d", p, 800.0) for p in (1, 2, 3)], "doc string, page int, page_height double")
    assert {r.text for r in layout.hinges(blocks, starts, pages, "doc", "page").collect()} == {"near", "far", "foot"}


def test_lines_lose_all_carriage_returns_and_pages_are_trimmed(spark):
    pages = spark.createDataFrame([(1, 1, "a\r\r\fb"), (1, 2, None)], "doc int, page int, text string")
    assert [r.line for r in lines.page_lines(pages, ["doc", "page"]).orderBy("page", "line_no").collect()] == ["a", "b", ""]
    texts = [(1, "abc-\n"), (2, "   "), (3, "\ndef"), (4, None), (5, " -"), (6, "x")]
    pages = spark.createDataFrame([("d", *t) for t in texts], "doc string, page int, text string")
    assert lines.stitch(pages, "doc", "page").first().text == "abcdef\nx"


def test_noise_lines(spark):
    said = ["a", " RAZÓN: b", "12", "12345", "", "x Firmado digitalmente y", "h", "sellodigital.sea.gob.cl", "٣٤"]
    rows = spark.createDataFrame([("d", k, t) for k, t in enumerate(said)], "doc string, line_no int, line string")
    often = spark.createDataFrame([("d", "h"), ("e", "a")], "doc string, line string")
    left = lines.drop_noise(rows, often, "doc")
    assert [r.line for r in left.orderBy("line_no").collect()] == ["a", "12345", ""]
    assert lines.page_texts(left, ["doc"]).first().text == "a\n12345\n"


def closure(rects, gap):
    """All boxes merged until none are near, whatever the order."""
    boxes = [tuple(map(float, r)) for r in rects]
    done = False
    while not done:
        done = True
        for i in range(len(boxes)):
            for j in range(i):
                a, b = boxes[i], boxes[j]
                if max(a[0] - b[2], b[0] - a[2], a[1] - b[3], b[1] - a[3]) <= gap:
                    rest = [x for k, x in enumerate(boxes) if k not in (i, j)]
                    boxes, done = [*rest, (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))], False
                    break
            if not done:
                break
    return sorted(boxes)


def test_rects_close_to_their_closure(spark):
    rng = np.random.default_rng(4)
    rows = []
    for page in range(30):
        for k in range(int(rng.integers(1, 14))):
            x, y, w, h = rng.integers(0, 300, 2).tolist() + rng.integers(1, 40, 2).tolist()
            rows.append((page, k, float(x), float(y), float(x + w), float(y + h)))
    df = spark.createDataFrame(rows, "page int, seq int, x0 double, y0 double, x1 double, y1 double")
    got = {}
    for r in layout.merge_rects(df, ["page"], (12.0, 24.0)).collect():
        got.setdefault(r.page, []).append(tuple(r)[2:])
    for page in range(30):
        first = closure([r[2:] for r in rows if r[0] == page], 12.0)
        assert sorted(got[page]) == closure(first, 24.0)
    # Two near boxes and a far one: the sweep turns the order round.
    assert layout.close_rects([(0, 0, 10, 10), (15, 0, 20, 10), (100, 100, 110, 110)], 10) == [(100, 100, 110, 110), (0, 0, 20, 10)]


SPAN = "page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, is_bold boolean"


def test_lines_and_bold_blocks(spark):
    spans = [
        (1, 0, "2.", 0, 100.0, 10, 110, True), (1, 1, "Título", 12, 101.0, 60, 111, True), (1, 2, ",", 62, 100.2, 64, 110, False), (1, 3, "lejos", 90, 99.9, 120, 110, True),
        (1, 4, "sigue  aquí", 5, 114.0, 60, 124, True), (1, 5, "(", 0, 300.0, 5, 310, False), (1, 6, "x", 6, 300.0, 10, 310, False), (1, 7, None, 0, 0.0, 1, 1, False), (1, 8, "", 0, 0.0, 1, 1, True),
        (2, 0, "b", 20, 370.65, 30, 380, True), (2, 1, "a", 0, 370.6, 10, 380, True),
    ]
    df = spark.createDataFrame([tuple(float(v) if k in (3, 4, 5, 6) else v for k, v in enumerate(s)) for s in spans], SPAN)
    rows = layout.assemble_lines(df, ["page"]).orderBy("page", "line_no").collect()
    assert [(r.page, r.text, round(r.bold_share, 2)) for r in rows] == [(1, "2. Título, lejos", 0.75), (1, "sigue  aquí", 1.0), (1, "(x", 0.0), (2, "a b", 1.0)]
    assert tuple(rows[0])[3:7] == (0.0, 99.9, 120.0, 111.0)
    bold = layout.merge_bold(layout.assemble_lines(df, ["page"]), ["page"]).orderBy("page", "block_no").collect()
    assert [tuple(r) for r in bold] == [(1, 0, "2. Título, lejos sigue aquí", 0.0, 99.9, 120.0, 124.0), (2, 0, "a b", 0.0, 370.6, 30.0, 380.0)]


def test_bold_blocks_keep_single_tabs(spark):
    rows = [(1, 0, "a\tb", 0.0, 0.0, 9.0, 9.0, 1.0), (1, 1, "c \t d", 0.0, 12.0, 9.0, 20.0, 1.0), (1, 2, "", 0.0, 21.0, 9.0, 30.0, 1.0), (1, 3, "e", 0.0, 22.0, 9.0, 30.0, 0.5)]
    df = spark.createDataFrame(rows, "page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, bold_share double")
    assert [r.text for r in layout.merge_bold(df, ["page"]).collect()] == ["a\tb c d"]


def plain_lines(spans, cfg=layout.LAYOUT):
    """Lines of one page's spans (text, x0, y0, x1, y1, bold) by the rule itself."""
    lines = []
    for s in sorted(spans, key=lambda s: (round(s[2], 1), s[1])):
        at = next((x for x in lines if abs(x[0] - s[2]) <= cfg.row_gap), None)
        if at is None:
            lines.append([s[2], s])
        else:
            at[0] = (at[0] + s[2]) / 2
            at.append(s)
    out = []
    for _, *got in lines:
        text, end = "", None
        for t, x0, _, x1, *_ in sorted(got, key=lambda s: s[1]):
            if end is not None and (x0 - end > cfg.word_gap or not (text[-1:] in tuple(' -“"(/') or t[:1] in tuple(",.):;"))):
                text += " "
            text, end = text + t, x1
        _, x0, y0, x1, y1, bold = zip(*got)
        out.append((text.strip(), min(x0), min(y0), max(x1), max(y1), sum(bold) / len(bold)))
    out.sort(key=lambda r: (r[2], r[1]))
    return [(k, *r) for k, r in enumerate(out)]


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_lines_by_brute_force_across_batches(spark, batch):
    rng = np.random.default_rng(12)
    words = ["a", "“", "x“", "Ü", "ñ-", "(", ",b", ".", "/", " ", "\u00a0c", "e\x1c", "d ", "Ӝ", ":", '"']
    pages = {}
    for page in range(40):
        n = int(rng.integers(1, 60))
        y = rng.choice([rng.integers(0, 400, n) * 0.05, rng.integers(0, 40, n) * 0.5, rng.uniform(0, 90, n)][page % 3], n)
        pages[page] = [(str(rng.choice(words)), float(x), float(h), float(x + w), float(h + 5), bool(b)) for x, h, w, b in zip(rng.integers(0, 60, n), y, rng.integers(1, 12, n), rng.integers(0, 2, n))]
    rows = [(p, k, *s) for p, spans in pages.items() for k, s in enumerate(spans)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows)).tolist()], "page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, is_bold boolean")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {}
        for r in layout.assemble_lines(df, ["page"]).collect():
            got.setdefault(r.page, []).append(tuple(r)[1:])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert {p: sorted(v) for p, v in got.items()} == {p: plain_lines(v) for p, v in pages.items()}


def test_heights_are_rounded_as_python_does():
    y = np.concatenate([np.arange(-4000, 40000) * 0.05, np.arange(3000) * 0.125, [1e16 + 2, 123456789012.35, -0.04, np.inf]])
    assert layout._tenths(y).tolist() == [round(v, 1) for v in y.tolist()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["line_assembly", "bold_merge"])
def test_pages_stream_and_spans_are_not_shuffled(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in plan and "ArrowEvalPython" not in plan
    assert plan.rindex("Exchange ") > plan.rindex("Generate ")  # the last line is the scan


def test_spans_are_neither_windowed_nor_sorted(spark):
    plan = plan_of(catalog.QUERIES["line_assembly"](spark, "/root/testdata/sf0.001"))
    assert "Window" not in plan and plan.count("Sort ") == 1 and plan.rindex("Sort ") > plan.rindex("Generate ")


@pytest.mark.parametrize("seq", ["int", "struct<a int, b int>"])
@pytest.mark.parametrize("batch", ["1", "7", "10000"])
def test_lines_of_pages_that_stand_together(spark, batch, seq):
    """Pages in any order, some with rows out of order, equal or missing seq, and one without a key."""
    rng = np.random.default_rng(5)
    rows = []
    for page in [3, None, 1, 9, 2, 7]:
        at = [None if page == 7 and k % 5 == 0 else k // (1 + (page == 9)) for k in range(12)]
        part = [(page, "doc", k, str(rng.choice(["a", "b,", "(", "\u201c", ""])), float(x), float(y), float(x) + 3, float(y) + 5, bool(x % 2)) for k, x, y in zip(at, rng.integers(0, 9, 12), rng.integers(0, 4, 12) * 3)]
        rows += part if page in (3, 1) else [part[i] for i in rng.permutation(12)]
    if seq != "int":
        rows = [(*r[:2], None if r[2] is None else (r[2] // 4, r[2]), *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, f"page int, doc string, seq {seq}, text string, x0 double, y0 double, x1 double, y1 double, is_bold boolean").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, want = (sorted(map(str, layout.assemble_lines(df, ["doc", "page"], together=x).collect())) for x in (True, False))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == want and len({r.split("page=")[1].split(",")[0] for r in got}) == 6


def test_formatting_of_questions():
    assert questions.formatted("uno\ndos\n\na  b   c\nd  e\nfin") == "uno dos\na;b;c\nd;e;\nfin"
    assert questions.formatted("lista:\na) x\nb) y\r\n") == "lista: \n a) x \n b) y"
    assert questions.formatted("") == "" == questions.formatted(None) and questions.formatted("\f\n \n") == ""
    table = ["antes", "Tabla XX. Partes y obras del Proyecto", "saltada", "[Nombre parte/obra 1]", "una des-", "cripción", "[Temporal o permanente]", "[Construcción, operación y cierre]", "",
             "[Nombre parte/obra 2]", "otra", "[otra fase]", "Tabla XX.  partes y obras del proyecto", "x", "[nombre parte/obra 3]", "12.", "después"]
    want = ["antes", "Tabla;Nombre;Descripción;Carácter;Fase"]
    title = "Tabla XX. Partes y obras del Proyecto"
    want += [f"{title};[Nombre parte/obra 1];una descripción;Temporal o permanente;Construcción, operación y cierre"]
    # A name without a character cell takes everything up to the next name or character cell.
    want += [f"{title};[Nombre parte/obra 2];otra [otra fase] Tabla XX. partes y obras del proyecto x;;nombre parte/obra 3"]
    assert questions.formatted("\n".join(table)) == "\n".join([*want, "12. después"])
    assert questions.formatted("a\nTabla XX. Partes y obras del Proyecto\nb") == "a\nTabla XX. Partes y obras del Proyecto b"


def test_asof_lookup_and_parts(spark):
    e = spark.createDataFrame([("d", 1, "l", 10), ("d", 2, "r", 20), ("d", 3, "l", 30), ("e", 1, "l", 5)], "doc string, at int, side string, v int")
    back = hierarchy.asof_backward(e, ["doc"], ["at"], F.col("side") == "r", "v", "b")
    both = {(r.doc, r.at): (r.b, r.f) for r in hierarchy.asof_forward(back, ["doc"], ["at"], F.col("side") == "r", "v", "f").collect()}
    assert both == {("d", 1): (None, 20), ("d", 2): (20, 20), ("d", 3): (20, None), ("e", 1): (None, None)}
    assert hierarchy.number_parts(e, ["doc", "side"], ["at"]).agg(F.sum("part")).first()[0] == 5
    last = hierarchy.last_write(e, ["doc", "side"], ["at"])
    assert {(r.doc, r.side, r.v) for r in last.collect()} == {("d", "l", 30), ("d", "r", 20), ("e", "l", 5)}
    assert hierarchy.last_write(e.limit(0), ["doc"], ["at"]).count() == 0


def test_classified_records_and_details(spark):
    tax = [(0, "A", "Uno", 0, "co₂"), (0, "A", "Uno", 1, "ruido"), (0, "A", "Uno", 2, "ruido de fondo"), (1, "B", "Dos", 0, "Agua"), (1, "B", "Dos", 1, "água"), (2, "C", "Tres", 0, "pas"), (2, "C", "Tres", 1, "  ")]
    tax = spark.createDataFrame(tax, "topic_pos int, topic_id string, topic_name string, kw_pos int, keyword string")
    q = [("d", 0, "AGUA", "ruido de  fondo", 7, "El CO₂ y el pas"), ("d", 1, None, None, 8, None), ("d", 2, "", "pasos", 9, "so2₂ pás")]
    rows = spark.createDataFrame([(*r, []) for r in q], "doc_id string, seq int, capitulo string, bisagra string, numero int, texto string, tablas_figuras array<struct<tipo string, parte int, png string>>")
    out, detail, total = classify.classify_questions(rows, tax)
    a, b, c = out.orderBy("seq").collect()
    assert (a.tema_principal_id, a.score, a.temas_principales_id, a.keywords_match) == ("A", 11.0, ["A"], ["co₂", "ruido", "ruido de fondo"])
    assert [tuple(x) for x in a.temas_secundarios] == [("Dos", 6.0)]  # both spellings fold to one form and count each
    assert (b.tema_principal, b.score, b.temas_principales, b.capitulo) == ("Sin clasificar", 0.0, [], None) and c.tema_principal_id == "SIN_CLASIFICAR"
    d = detail.where("seq = 0").first().temas
    assert [t.id for t in d] == ["A", "B"] and d[0].detalle.bisagra == ["ruido", "ruido de fondo"] and d[0].detalle.texto == ["co₂"] and d[1].detalle.capitulo[0] == "Agua"
    assert tuple(total.first()) == (3, 1, 2)
    assert classify.classify_questions(rows, tax.limit(0))[2].first().classified == 0
