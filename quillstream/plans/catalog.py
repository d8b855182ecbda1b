"""Queries over the driver's tables, one per operator family, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import classify, hierarchy, jobs, layout, lines, questions
from ..sources import tables
from ..sources.tables import table
from . import extraction

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: A small taxonomy of words that occur in the tables: a repeated entry, a nested pair, short words, a tie.
TAXONOMY = [
    ("FUNC_ES", "Palabras", ["de", "la", "que", "de"]), ("FUNC_EN", "Words", ["the", "and", "of"]), ("LONG_EN", "Endings", ["tionth", "tion", "ingble"]),
    ("FUNC_DE", "Wörter", ["der", "und", "ein"]), ("LONG_FR", "Finales", ["eauxi", "aiquement", "éau"]), ("TIE", "Gleich", ["und", "der", "ein"]),
]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def taxonomy(spark: SparkSession) -> DataFrame:
    rows = [(p, i, n, k, w) for p, (i, n, ws) in enumerate(TAXONOMY) for k, w in enumerate(ws)]
    return spark.createDataFrame(rows, "topic_pos int, topic_id string, topic_name string, kw_pos int, keyword string")


def zones(spark: SparkSession, d: str) -> DataFrame:
    """A document as a question: source is the chapter, its first line the hinge."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.col("source").alias("chapter"), F.split("text", "\n")[0].alias("hinge"), "text")


_NORM = "trim(regexp_replace(lower(coalesce({c}, '')), '[\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\x{{A0}}]+', ' ', 'g'))"
_FOLD = f"translate({_NORM}, 'áéíóúüñ', 'aeiouun')"
_TAX = "tax(topic_pos, topic_id, topic_name, kw_pos, keyword) AS (VALUES " + ", ".join(f"({p}, '{i}', '{n}', {k}, '{w}')" for p, (i, n, ws) in enumerate(TAXONOMY) for k, w in enumerate(ws)) + ")"
_Z = f"z0 AS MATERIALIZED (SELECT doc_id, {_FOLD.format(c='source')} AS chapter, {_FOLD.format(c=chr(115) + 'plit_part(text, chr(10), 1)')} AS hinge, {_FOLD.format(c='text')} AS body FROM documents)"
_WRD = "(' ' || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g') || ' ')"
_Z += ", z AS MATERIALIZED (SELECT *, " + ", ".join(f"{_WRD.format(c=c)} AS {c}_w" for c in ("chapter", "hinge", "body")) + " FROM z0)"
_HIT = "(CASE WHEN length(f) <= 4 THEN contains({w}, ' ' || f || ' ') ELSE contains({c}, f) END)"
_SCORE = " + ".join(f"CASE WHEN {_HIT.format(w=c + "_w", c=c)} THEN {n} ELSE 0 END" for c, n in (("chapter", 3.0), ("hinge", 5.0), ("body", 1.0)))
_TOPICS = f"""{_TAX}, {_Z}, e AS MATERIALIZED (SELECT *, {_FOLD.format(c='keyword')} AS f FROM tax),
s AS (SELECT doc_id, topic_pos, topic_id, topic_name, kw_pos, keyword, CAST({_SCORE} AS DOUBLE) AS s FROM z, e),
t AS MATERIALIZED (SELECT doc_id, topic_pos, topic_id, topic_name, sum(s) AS score, string_agg(keyword, '|' ORDER BY kw_pos) FILTER (s > 0) AS matches FROM s GROUP BY ALL HAVING sum(s) >= 2)"""


@query("classify_documents", f"""WITH {_TOPICS},
m AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_pos) AS r FROM t),
p AS (SELECT doc_id, string_agg(topic_name, '|' ORDER BY r) FILTER (score >= greatest(2.0, 0.8::DOUBLE * top)) AS mains,
  max(topic_name) FILTER (r = 1) AS tema_principal, max(topic_id) FILTER (r = 1) AS tema_principal_id, max(score) FILTER (r = 1) AS score, max(matches) FILTER (r = 1) AS keywords_match,
  list(topic_name ORDER BY r) FILTER (score < greatest(2.0, 0.8::DOUBLE * top)) AS sec FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(tema_principal, 'Sin clasificar') AS tema_principal, coalesce(tema_principal_id, 'SIN_CLASIFICAR') AS tema_principal_id,
  coalesce(mains, '') AS temas_principales, coalesce(score, 0.0)::DOUBLE AS score, coalesce(array_to_string(sec[1:3], '|'), '') AS temas_secundarios, coalesce(keywords_match, '') AS keywords_match
FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id""")
def classify_documents(spark, d):
    out = classify.classify(zones(spark, d), taxonomy(spark), "doc_id").drop("temas", "temas_principales_id", "temas_secundarios_score")
    return out.withColumns({c: F.array_join(c, "|") for c in ("temas_principales", "temas_secundarios", "keywords_match")})


_ZONED = ", ".join(f"coalesce(string_agg(keyword, '|' ORDER BY kw_pos) FILTER ({_HIT.format(w=c + '_w', c=c)}), '') AS {n}" for c, n in (("chapter", "capitulo"), ("hinge", "bisagra"), ("body", "texto")))


@query("classify_detail", f"""WITH {_TOPICS}, x AS (SELECT z.doc_id, e.topic_pos, {_ZONED} FROM z, e GROUP BY ALL)
SELECT t.doc_id, t.topic_id AS id, t.topic_name AS nombre, t.score, x.capitulo, x.bisagra, x.texto, t.topic_id IN (SELECT topic_id FROM m WHERE m.doc_id = t.doc_id) AS principal
FROM t JOIN x ON x.doc_id = t.doc_id AND x.topic_pos = t.topic_pos""".replace(", x AS (", ", m AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM t) WHERE score >= greatest(2.0, 0.8::DOUBLE * top)), x AS ("))
def classify_detail(spark, d):
    q = zones(spark, d).select("doc_id", F.lit(0).alias("seq"), F.col("chapter").alias("capitulo"), F.col("hinge").alias("bisagra"), F.lit(1).alias("numero"), F.col("text").alias("texto"), F.array().alias("tablas_figuras"))
    _, detail, _ = classify.classify_questions(q, taxonomy(spark))
    rows = detail.select("doc_id", "temas_principales_id", F.explode("temas").alias("t"))
    zones_of = [F.array_join(F.col("t.detalle")[z], "|").alias(z) for z in ("capitulo", "bisagra", "texto")]
    return rows.select("doc_id", "t.id", "t.nombre", "t.score", *zones_of, F.array_contains("temas_principales_id", F.col("t.id")).alias("principal"))


@query("topic_scores", f"WITH {_TOPICS} SELECT doc_id, topic_pos, topic_id, topic_name, score, matches FROM t")
def topic_scores(spark, d):
    return classify.topic_scores(zones(spark, d), taxonomy(spark), "doc_id").withColumn("matches", F.array_join("matches", "|"))


@query("topic_distribution", f"""WITH {_TOPICS}, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_pos) AS r FROM t)
SELECT coalesce(topic_name, 'Sin clasificar') AS tema_principal, count(*) AS n FROM documents d LEFT JOIN (SELECT * FROM m WHERE r = 1) x ON d.doc_id = x.doc_id GROUP BY 1""")
def topic_distribution(spark, d):
    return classify.distribution(classify.classify(zones(spark, d), taxonomy(spark), "doc_id"))


@query("classification_summary", f"WITH {_TOPICS} SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(DISTINCT doc_id) FROM t) AS classified, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT doc_id) FROM t) AS unclassified")
def classification_summary(spark, d):
    return classify.summary(classify.classify(zones(spark, d), taxonomy(spark), "doc_id"))


@query("normalize_fold", f"SELECT doc_id, md5({_NORM.format(c='text')}) AS normal, md5({_FOLD.format(c='text')}) AS folded FROM documents")
def normalize_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize(F.col("text")).cast("binary")).alias("normal"), F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


_STRIP = "regexp_replace({c}, '^[\\x09-\\x0D\\x1C-\\x20]+|[\\x09-\\x0D\\x1C-\\x20]+$', '', 'g')"
_LINES = f"l AS (SELECT source, doc_id, {_STRIP.format(c='unnest(string_split(text, chr(10)))')} AS line FROM documents)"
_FREQ = f"{_LINES}, np AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM l GROUP BY 1), sn AS (SELECT source, line, count(DISTINCT doc_id) AS n FROM l WHERE line <> '' GROUP BY ALL), fr AS (SELECT source, line, n FROM sn JOIN np USING (source) WHERE n >= greatest(2, floor(n_pages * 0.05::DOUBLE)))"


def _page_lines(spark, d):
    return lines.page_lines(table(spark, d, "documents"), ["source", "doc_id"])


@query("frequent_lines", f"WITH {_FREQ} SELECT * FROM fr")
def frequent_lines(spark, d):
    return lines.frequent_lines(_page_lines(spark, d), "source", "doc_id", 0.05, table(spark, d, "documents").select("source", "doc_id"))


_PHRASES = " OR ".join(f"contains(lower(line), '{p}')" for p in ("para validar las firmas de este documento", "sea.gob.cl/validar", "validar las firmas", "firmado digitalmente", "sellodigital.sea.gob.cl", "razón:", "razon:"))


@query("noise_line_filter", f"""WITH {_FREQ.replace("doc_id, regexp", "doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, regexp")},
n AS (SELECT * FROM (SELECT source, doc_id, i, CASE i % 11 WHEN 3 THEN 'x RAZÓN: ' || line WHEN 5 THEN 'Sellodigital.sea.gob.cl' WHEN 7 THEN '1234' WHEN 8 THEN '12345' WHEN 9 THEN '' ELSE line END AS line, line AS old FROM l))
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY i)) AS h FROM n WHERE NOT regexp_full_match(line, '[0-9]{{1,4}}') AND NOT ({_PHRASES}) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.source = n.source AND fr.line = n.line) GROUP BY doc_id""")
def noise_line_filter(spark, d):
    """Lines with noise put in; the frequent set is that of the lines as they were."""
    rows = _page_lines(spark, d)
    often = lines.frequent_lines(rows, "source", "doc_id", 0.05, table(spark, d, "documents").select("source", "doc_id"))
    at = (F.col("line_no") + 1) % 11
    put = F.when(at == 3, F.concat(F.lit("x RAZÓN: "), text.strip(F.col("line")))).when(at == 5, "Sellodigital.sea.gob.cl").when(at == 7, " 1234 ").when(at == 8, "12345").when(at == 9, "").otherwise(F.col("line"))
    out = lines.drop_noise(rows.withColumn("line", put), often, "source")
    texts = lines.page_texts(out, ["source", "doc_id"])
    return texts.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("h"))


@query("stitch_pages", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, (generate_subscripts(string_split(text, chr(10)), 1) - 1) AS i FROM documents),
w AS (SELECT doc_id, i // 3 AS p, string_agg(line, chr(10) ORDER BY i) AS t FROM l GROUP BY ALL),
g AS (SELECT doc_id, p, {_STRIP.format(c="t || CASE WHEN (doc_id + p) % 4 = 0 THEN '-' ELSE '' END")} AS t FROM w WHERE (doc_id + p) % 7 <> 6),
k AS (SELECT *, p = max(p) OVER (PARTITION BY doc_id) AS fin FROM g WHERE t <> '')
SELECT doc_id, md5(string_agg(CASE WHEN fin THEN t WHEN right(t, 1) = '-' THEN left(t, length(t) - 1) ELSE t || chr(10) END, '' ORDER BY p)) AS h FROM k GROUP BY doc_id""")
def stitch_pages(spark, d):
    """Pages of three lines with white space around them, hyphens at some ends and blank pages between."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("page", F.floor(F.col("line_no") / 3))
    rows = lines.page_texts(rows, ["doc_id", "page"])
    mark = F.when((F.col("doc_id") + F.col("page")) % 4 == 0, "-\n ").otherwise(" \n")
    shown = F.when((F.col("doc_id") + F.col("page")) % 7 == 6, " \n\t").otherwise(F.concat(F.lit("\n "), "text", mark))
    return lines.stitch(rows.withColumn("text", shown), "doc_id", "page").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))


@query("table_rows", "WITH r AS (SELECT doc_id, unnest(string_split(replace(text, ' | ', '   '), chr(10))) AS line FROM documents), c AS (SELECT doc_id, list_filter(regexp_split_to_array(line, '\\s{2,}'), lambda x: trim(x) <> '') AS c FROM r) SELECT doc_id, count(*) AS n, sum(len(c))::BIGINT AS n_cells FROM c WHERE len(c) >= 2 GROUP BY doc_id")
def table_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit(" | "), F.lit("   ")), "\n")).alias("line"))
    return rows.where(text.is_table_row(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(text.cells(F.col("line"))).cast("long")).alias("n_cells"))


@query("signature_cleanup", """WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' || text WHEN 2 THEN text || chr(10) || 'y 31 de mayo de 2024. fin' ELSE text || chr(10) || 'a  b' END AS t FROM documents)
SELECT doc_id, md5(regexp_replace(t, '\\s+$', '')) AS h FROM s""")
def signature_cleanup(spark, d):
    """Signature blocks at the end, in the middle and on both sides of a date that only the end loses."""
    sign = "Firmado Digitalmente por Ana Paz\nFecha: 01/02/2024 10:11:12 UTC -03:00 Lugar: "
    k, t = F.col("doc_id") % 4, F.col("text")
    put = F.when(k == 0, F.concat(t, F.lit(f"\n{sign}\n3 de mayo de 2024.")))
    put = put.when(k == 1, F.concat(F.lit("  "), t, F.lit("\nFECHA: 1-2-24  9:05  FIRMADO  DIGITALMENTE  POR  x")))
    put = put.when(k == 2, F.concat(t, F.lit("\ny 31 de mayo de 2024. fin\nfirmado digitalmente por y")))
    put = put.otherwise(F.concat(t, F.lit("\na Fecha: 01/02/2024 10:11:12 UTC -03:00 Lugar: b 1 de Água_9 de 1999. \n")))
    put = F.when(k == 3, F.concat(t, F.lit("\na Fecha: 01/02/2024 10:11:12 UTC-03:00 Lugar:Fecha: 1/2/24 1:11 b 1 de Água_9 de 1999. \n"))).otherwise(put)
    return table(spark, d, "documents").select("doc_id", F.md5(F.replace(text.without_signature(put), F.lit("\na b"), F.lit("\na  b")).cast("binary")).alias("h"))


@query("trailing_hinge_cleanup", """SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN regexp_replace(text, '\\s+$', '') WHEN 1 THEN text || ' Anexo B' WHEN 2 THEN regexp_replace(text, '\\s+$', '') || ' Anexo'
WHEN 3 THEN text || ' Anexo A. Otro' ELSE text || ' Anexo A. x' END) AS h FROM documents""")
def trailing_hinge_cleanup(spark, d):
    """The first hinge that fits goes, whole or without its point, once; blank hinges and others stay."""
    ends = (" Anexo A \n", " Anexo B", " Anexo xo A.", " Anexo A. Otro Otro.", " Anexo A. x")
    t = F.concat("text", F.element_at(F.array(*map(F.lit, ends)), (F.col("doc_id") % 5 + 1).cast("int")))
    hinges = F.array(*map(F.lit, ("", " ", "Otro.", "xo A.", "Anexo A.", "o A")))
    hinges = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Anexo A."), F.lit("xo A"))).otherwise(hinges)
    return table(spark, d, "documents").select("doc_id", F.md5(text.without_trailing(t, hinges).cast("binary")).alias("h"))


_O = "o AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(o_orderkey % 20 AS BIGINT) AS num FROM orders)"


def _numbers(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.pmod("o_orderkey", F.lit(20)).alias("num"))


@query("continuity_filter", f"WITH {_O} SELECT o_custkey, o_orderkey, num FROM (SELECT *, max(num) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o) WHERE num >= coalesce(m, -1)")
def continuity_filter(spark, d):
    return hierarchy.continuity(_numbers(spark, d), ["o_custkey"], ["o_orderdate", "o_orderkey"], "num").select("o_custkey", "o_orderkey", "num")


@query("monotonic_filter", f"""WITH RECURSIVE {_O}, q AS (SELECT o_custkey, num, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM o),
w(o_custkey, i, last, kept) AS (SELECT o_custkey, i, num, num::VARCHAR FROM q WHERE i = 1 UNION ALL
SELECT q.o_custkey, q.i, CASE WHEN w.last - q.num >= 5 THEN w.last ELSE q.num END, CASE WHEN w.last - q.num >= 5 THEN w.kept ELSE w.kept || ',' || q.num END FROM w JOIN q ON q.o_custkey = w.o_custkey AND q.i = w.i + 1)
SELECT o_custkey, arg_max(kept, i) AS kept FROM w GROUP BY 1""")
def monotonic_filter(spark, d):
    seq = _numbers(spark, d).groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "num"))).alias("s"))
    return seq.select("o_custkey", F.array_join(hierarchy.monotonic(F.transform("s", lambda x: x["num"])), ",").alias("kept"))


_EV = "ev AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 'chapter' WHEN 'signup' THEN 'hinge' ELSE 'question' END AS kind, event_type || event_id AS text FROM events)"
_TL = f"""{_EV}, c AS (SELECT *, sum((kind = 'chapter')::INT) OVER w AS chapter_no, last_value(CASE WHEN kind = 'chapter' THEN text END IGNORE NULLS) OVER w AS chapter FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
tl AS (SELECT *, last_value(CASE WHEN kind = 'hinge' AND chapter_no > 0 THEN text END IGNORE NULLS) OVER (PARTITION BY user_id, chapter_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS hinge FROM c)"""


def _timeline(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "chapter").when(F.col("event_type") == "signup", "hinge").otherwise("question")
    e = e.select("user_id", "ts", "event_id", kind.alias("kind"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return hierarchy.timeline(e, ["user_id"], ["ts", "event_id"])


@query("hierarchy_assign", f"WITH {_TL} SELECT user_id, event_id, chapter, hinge FROM tl WHERE kind = 'question' AND chapter_no > 0")
def hierarchy_assign(spark, d):
    return _timeline(spark, d).where("kind = 'question' and chapter_no > 0").select("user_id", "event_id", "chapter", "hinge")


@query("hierarchy_nested", f"WITH {_TL} SELECT user_id, chapter_no::BIGINT AS chapter_no, max(chapter) AS chapter, count_if(kind = 'hinge') AS n_hinges, count_if(kind = 'question') AS n_questions, count_if(kind = 'question' AND hinge IS NULL) AS n_without FROM tl WHERE chapter_no > 0 GROUP BY ALL")
def hierarchy_nested(spark, d):
    t = _timeline(spark, d).where("chapter_no > 0").groupBy("user_id", "chapter_no")
    q = F.col("kind") == "question"
    return t.agg(F.max("chapter").alias("chapter"), F.count_if(F.col("kind") == "hinge").alias("n_hinges"), F.count_if(q).alias("n_questions"), F.count_if(q & F.col("hinge").isNull()).alias("n_without"))


_NEST = f"""{_TL}, hn AS (SELECT *, sum((kind = 'hinge' AND chapter_no > 0)::INT) OVER (PARTITION BY user_id, chapter_no ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS hinge_no FROM tl)"""


@query("hierarchy_tree", f"""WITH {_NEST}, q AS (SELECT user_id, chapter_no, hinge_no, max(text) FILTER (kind = 'chapter') AS c, max(text) FILTER (kind = 'hinge') AS h, coalesce(string_agg(event_id, ',' ORDER BY ts, event_id) FILTER (kind = 'question'), '') AS n FROM hn WHERE chapter_no > 0 GROUP BY ALL),
g AS (SELECT user_id, chapter_no, max(c) AS c, coalesce(string_agg(h || '(' || n || ')', ';' ORDER BY hinge_no) FILTER (hinge_no > 0), '') AS hs, coalesce(max(n) FILTER (hinge_no = 0), '') AS free FROM q GROUP BY ALL),
a AS (SELECT user_id, chapter_no, coalesce(string_agg(event_id, ',' ORDER BY ts, event_id) FILTER (kind = 'question'), '') AS al FROM hn WHERE chapter_no > 0 GROUP BY ALL)
SELECT user_id, md5(string_agg(c || ':' || al || '|' || hs || '|' || free, chr(10) ORDER BY chapter_no)) AS tree FROM g JOIN a USING (user_id, chapter_no) GROUP BY user_id""")
def hierarchy_tree(spark, d):
    """The nested chapters, hinges and questions of each user, as one text."""
    e = _timeline(spark, d).withColumns({"page": F.lit(1), "bbox": F.array(F.lit(0.0))})
    rows = hierarchy.nested(e, ["user_id"], ["ts", "event_id"], number="event_id")
    joined = lambda c: F.array_join(c, ",")
    hinge = lambda h: F.concat(h["text"], F.lit("("), joined(h["questions"]), F.lit(")"))
    chapter = lambda c: F.concat(c["text"], F.lit(":"), joined(c["questions"]), F.lit("|"), F.array_join(F.transform(c["hinges"], hinge), ";"), F.lit("|"), joined(c["questions_without_hinge"]))
    return rows.select("user_id", F.md5(F.array_join(F.transform("chapters", chapter), "\n").cast("binary")).alias("tree"))


@query("lookup_last_wins", f"""WITH {_NEST}, r AS (SELECT user_id, event_id % 5 AS number, chapter, hinge, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY chapter_no DESC, (hinge_no = 0) DESC, hinge_no DESC, ts DESC, event_id DESC) AS r FROM hn WHERE kind = 'question' AND chapter_no > 0)
SELECT user_id, number::BIGINT AS number, chapter AS capitulo, hinge AS bisagra FROM r WHERE r = 1""")
def lookup_last_wins(spark, d):
    e = _timeline(spark, d).withColumn("number", F.pmod("event_id", F.lit(5)))
    return hierarchy.lookup(e, ["user_id"], ["ts", "event_id"], "number")


@query("last_write", "SELECT user_id, event_id % 50 AS number, max(event_id) AS event_id FROM events GROUP BY ALL")
def last_write(spark, d):
    return hierarchy.last_write(table(spark, d, "events").withColumn("number", F.pmod("event_id", F.lit(50))), ["user_id", "number"], ["event_id"]).select("user_id", "number", "event_id")


@query("asof_backward", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def asof_backward(spark, d):
    e = table(spark, d, "events")
    return hierarchy.asof_backward(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_id", "last_purchase").select("user_id", "event_id", "last_purchase")


@query("asof_forward_tolerance", "WITH n AS (SELECT user_id, event_id, event_type, ts, first_value(CASE WHEN event_type = 'click' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM events) SELECT user_id, event_id, coalesce(epoch(nx) - epoch(ts) <= 86400, false) AS is_hinge FROM n WHERE event_type <> 'click'")
def asof_forward_tolerance(spark, d):
    e = hierarchy.asof_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "ts", "nx").where("event_type <> 'click'")
    gap = F.col("nx").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")
    return e.select("user_id", "event_id", F.coalesce(gap <= 86400, F.lit(False)).alias("is_hinge"))


@query("adjacent_semi", "WITH p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) SELECT a.user_id, a.day FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE b.user_id = a.user_id AND b.day = a.day + 1)")
def adjacent_semi(spark, d):
    p = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return hierarchy.with_next(p, ["user_id"], "day")


@query("part_numbering", "SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS part, lpad((l_linenumber)::VARCHAR, 3, '0') AS label FROM lineitem")
def part_numbering(spark, d):
    li = hierarchy.number_parts(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return li.select("l_orderkey", "l_linenumber", "l_returnflag", F.col("part").cast("long").alias("part"), F.format_string("%03d", "l_linenumber").alias("label"))


@query("collect_regions", "SELECT o_orderkey, coalesce(string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_returnflag, l_linenumber), '') AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 30 GROUP BY 1")
def collect_regions(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 30").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = hierarchy.gathered(big, ["o_orderkey"], ["l_returnflag", "l_linenumber"], "p", ["l_returnflag", "l_linenumber"])
    joined = F.array_join(F.transform("p", lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"))), ",")
    orders = table(spark, d, "orders").select("o_orderkey")
    return hierarchy.with_default(orders, parts.select("o_orderkey", joined.alias("parts")), ["o_orderkey"], {"parts": ""})


@query("left_lookup_default", "SELECT c_custkey, coalesce(max(o_orderpriority), '') AS capitulo, max(o_orderkey) AS bisagra FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_lookup_default(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("capitulo"), F.max("o_orderkey").alias("bisagra"))
    return hierarchy.with_default(table(spark, d, "customer").select("c_custkey"), o, ["c_custkey"], {"capitulo": ""})


_SEG = """sg AS (SELECT l_suppkey, l_orderkey % 8 AS page, CASE WHEN l_orderkey % 3 = 0 THEN 'l' WHEN l_orderkey % 7 = 0 THEN 'c' ELSE 're' END AS op, CASE WHEN l_linenumber % 3 = 0 THEN y1 ELSE x1 END AS x1, CASE WHEN l_linenumber % 3 = 0 THEN x1 ELSE y1 END AS y1,
CASE WHEN l_linenumber % 3 = 0 THEN y2 ELSE x2 END AS x2, CASE WHEN l_linenumber % 3 = 0 THEN x2 ELSE y2 END AS y2 FROM (SELECT *, l_partkey % 80 * 1.0 AS x1, l_orderkey % 90 * 1.0 AS y1, l_partkey % 80 + l_quantity * 2 AS x2, l_orderkey % 90 + l_discount * 15 AS y2 FROM lineitem))"""
_KIND = "CASE WHEN op = 'l' AND abs(x2-x1) >= 25 AND abs(y2-y1) <= 1.0::DOUBLE THEN 'h' WHEN op = 'l' AND abs(y2-y1) >= 25 AND abs(x2-x1) <= 1.0::DOUBLE THEN 'v' WHEN op = 're' AND abs(y2-y1) <= 1.2::DOUBLE AND abs(x2-x1) >= 25 THEN 'h' WHEN op = 're' AND abs(x2-x1) <= 1.2::DOUBLE AND abs(y2-y1) >= 25 THEN 'v' END"


def _drawings(spark, d):
    """Line items as drawing items: a supplier is a document, an eighth of its orders a page; every third stands upright."""
    up = F.col("l_linenumber") % 3 == 0
    x1, y1 = (F.col("l_partkey") % 80).cast("double"), (F.col("l_orderkey") % 90).cast("double")
    x2, y2 = x1 + F.col("l_quantity") * 2, y1 + F.col("l_discount") * 15
    turn = lambda a, b: F.when(up, b).otherwise(a)
    op = F.when(F.col("l_orderkey") % 3 == 0, "l").when(F.col("l_orderkey") % 7 == 0, "c").otherwise("re")
    item = F.struct(op.alias("op"), F.array(turn(x1, y1), turn(y1, x1), turn(x2, y2), turn(y2, x2)).alias("p"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_orderkey") % 8).cast("int").alias("page_no"), F.col("l_orderkey").alias("o"), item.alias("i"))
    rows = rows.groupBy("doc_id", "page_no", "o").agg(F.collect_list("i").alias("items"))
    return rows.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("items")).alias("drawings"))


@query("drawing_scan", f"WITH {_SEG} SELECT l_suppkey::VARCHAR AS doc_id, page::INT AS page_no, {_KIND} AS kind, count(*) AS n, round(sum(x1 + 2 * y1 + 3 * x2 + 4 * y2), 3) AS s FROM sg WHERE op <> 'c' GROUP BY ALL")
def drawing_scan(spark, d):
    rows = tables.drawing_items(_drawings(spark, d)).withColumn("kind", geometry.segment_kind())
    return rows.groupBy("doc_id", "page_no", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.expr("x1 + 2 * y1 + 3 * x2 + 4 * y2")), 3).alias("s"))


@query("table_gate", f"WITH {_SEG}, k AS (SELECT *, {_KIND} AS kind FROM sg) SELECT l_suppkey::VARCHAR AS doc_id, page::INT AS page_no, count_if(kind = 'h')::BIGINT AS n_h, count_if(kind = 'v')::BIGINT AS n_v FROM k WHERE kind IS NOT NULL GROUP BY ALL HAVING n_h >= 6 AND n_v >= 4 AND (max(greatest(x1, x2)) - min(least(x1, x2))) * (max(greatest(y1, y2)) - min(least(y1, y2))) >= 15000")
def table_gate(spark, d):
    return layout.table_pages(tables.drawing_items(_drawings(spark, d)).withColumn("kind", geometry.segment_kind()), ["doc_id", "page_no"])


@query("rect_overlap_anti", "WITH b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 3 AS x1, l_discount * 100 + 2 AS y1 FROM lineitem), r AS (SELECT s_suppkey, s_suppkey % 50 AS x0, 2.0 AS y0, s_suppkey % 50 + 10 AS x1, 6.0 AS y1 FROM supplier) SELECT l_orderkey, l_linenumber FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE s_suppkey = l_suppkey AND b.x0 < r.x1 AND r.x0 < b.x1 AND b.y0 < r.y1 AND r.y0 < b.y1)")
def rect_overlap_anti(spark, d):
    q, y = F.col("l_quantity"), F.col("l_discount") * 100
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("page"), q.alias("x0"), y.alias("y0"), (q + 3).alias("x1"), (y + 2).alias("y1"))
    x = F.col("s_suppkey") % 50
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("page"), x.alias("x0"), F.lit(2.0).alias("y0"), (x + 10).alias("x1"), F.lit(6.0).alias("y1"))
    return geometry.without_regions(b, r, ["page"]).select("l_orderkey", "l_linenumber")


@query("region_areas", "SELECT l_orderkey, count(*) AS n, round(sum(l_quantity * 20 * l_tax * 500), 3) AS s FROM lineitem WHERE l_quantity * 20 * l_tax * 500 >= 8000 GROUP BY 1")
def region_areas(spark, d):
    """Placements of every order as images; too small ones go (the areas of swapped corners are none)."""
    box = F.array(F.lit(1.0), F.lit(2.0), 1 + F.col("l_quantity") * 20, 2 + F.col("l_tax") * 500)
    swapped = F.array(F.lit(900.0), F.lit(2.0), F.lit(1.0), F.lit(900.0))
    images = F.collect_list(F.struct(F.array(box, swapped).alias("rects"))).alias("images")
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no")).agg(images)
    rows = tables.placements(pages).where(geometry.area() >= 8000)
    return rows.groupBy(F.col("doc_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(geometry.area()), 3).alias("s"))


_CH = "ch AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), cp AS (SELECT doc_id, i, CASE (doc_id + i) % 9 WHEN 0 THEN 'IV. ' WHEN 1 THEN ' xIx.  ' WHEN 2 THEN 'IV.' WHEN 3 THEN 'XXXXXXXXXXX. ' WHEN 4 THEN '12. ' WHEN 5 THEN ' 0034.' || chr(9) WHEN 6 THEN '12.' WHEN 7 THEN '12345. ' ELSE '' END || line AS t FROM ch)"


def _marked_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    marks = ("IV. ", " xIx.  ", "IV.", "XXXXXXXXXXX. ", "12. ", " 0034.\t", "12.", "12345. ", "")
    mark = F.element_at(F.array(*map(F.lit, marks)), ((F.col("doc_id") + F.col("i")) % 9 + 1).cast("int"))
    return rows.select("doc_id", "i", F.concat(mark, "line").alias("text"))


@query("chapter_predicate", f"WITH {_CH} SELECT doc_id, count(*) AS n, sum(i)::BIGINT AS s FROM cp WHERE regexp_matches(trim(t, ' ' || chr(9) || chr(13)), '^[IVXLCDMivxlcdm]{{1,10}}\\.\\s+[^\\n]+$') GROUP BY 1")
def chapter_predicate(spark, d):
    rows = _marked_lines(spark, d).where(layout.is_chapter(F.col("text")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))


@query("layout_question_starts", f"WITH {_CH} SELECT doc_id, regexp_extract(t, '^\\s*([0-9]{{1,4}})\\.\\s', 1)::INT AS num, count(*) AS n, sum(i)::BIGINT AS s FROM cp WHERE regexp_matches(t, '^\\s*[0-9]{{1,4}}\\.\\s') GROUP BY ALL")
def layout_question_starts(spark, d):
    return layout.question_starts(_marked_lines(spark, d)).groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))


_HB = """pg AS (SELECT DISTINCT o_custkey AS doc, o_orderkey % 6 AS page, 800.0 AS page_height FROM orders), bl AS (SELECT o_custkey AS doc, o_orderkey % 6 AS page, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'II. Cap' ELSE 'Sub' END AS text, o_totalprice % 780 AS y1 FROM orders),
st AS (SELECT o_custkey AS doc, o_orderkey % 6 AS page, (o_totalprice * 7) % 790 AS y0 FROM orders WHERE o_orderkey % 4 = 1)"""


@query("hinge_decision", f"""WITH {_HB} SELECT o_orderkey FROM bl WHERE text = 'Sub' AND (coalesce((SELECT min(y0) FROM st WHERE st.doc = bl.doc AND st.page = bl.page AND st.y0 >= bl.y1) - y1 <= 55, false)
OR (800.0 - y1 <= 120 AND EXISTS (SELECT 1 FROM st WHERE st.doc = bl.doc AND st.page = bl.page + 1 AND st.y0 <= 250)))""")
def hinge_decision(spark, d):
    """Orders as bold blocks and question starts on six pages per customer."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (F.col("o_orderkey") % 6).alias("page"), "o_orderkey", "o_totalprice")
    blocks = o.select("doc", "page", "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "II. Cap").otherwise("Sub").alias("text"), (F.col("o_totalprice") % 780).alias("y1"))
    starts = o.where("o_orderkey % 4 = 1").select("doc", "page", (F.col("o_totalprice") * 7 % 790).alias("y0"))
    pages = o.select("doc", "page").distinct().withColumn("page_height", F.lit(800.0))
    return layout.hinges(blocks, starts, pages, "doc", "page").select("o_orderkey")


_DET = """ev AS (SELECT user_id::VARCHAR AS doc, CAST(date_part('day', ts) AS INT) AS page, date_part('hour', ts)::DOUBLE AS y, event_id, event_type FROM events),
dt AS (SELECT doc, page, y, CASE event_type WHEN 'purchase' THEN 'tabla' ELSE 'figura' END AS tipo, event_id FROM ev WHERE event_type IN ('purchase', 'error')),
q AS (SELECT doc, page, y, event_id, event_id % 40 AS num FROM ev WHERE event_type = 'click'),
al AS (SELECT doc, page, y, 0 AS r, event_id, num, NULL AS tipo FROM q UNION ALL SELECT doc, page, y, CASE tipo WHEN 'tabla' THEN 1 ELSE 2 END, event_id, NULL, tipo FROM dt),
pa AS (SELECT *, last_value(num IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, y, r, event_id ROWS UNBOUNDED PRECEDING) AS pregunta FROM al)"""


@query("region_parts", f"""WITH {_DET} SELECT doc AS doc_id, page AS page_no, tipo, pregunta::INT AS pregunta, parte::INT AS parte, 'p' || lpad(coalesce(pregunta, 0)::VARCHAR, 3, '0') || '_parte' || lpad(parte::VARCHAR, 3, '0') || '_' || tipo || '.png' AS png
FROM (SELECT *, row_number() OVER (PARTITION BY doc, coalesce(pregunta, 0), tipo ORDER BY page, r, event_id) AS parte FROM pa WHERE tipo IS NOT NULL)""")
def region_parts(spark, d):
    """Events as regions and questions on the pages (days) of a user's document: parent question, part number, file name."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("doc_id"), F.day("ts").alias("page_no"), F.hour("ts").cast("double").alias("y0"), F.col("event_id").alias("part"), "event_type", *(F.lit(0.0).alias(s) for s in ("x0", "x1", "y1")))
    found = e.withColumn("tipo", F.when(F.col("event_type") == "purchase", "tabla").when(F.col("event_type") == "error", "figura")).where("tipo is not null").withColumn("rank", F.when(F.col("tipo") == "tabla", 0).otherwise(1))
    asked = e.where("event_type = 'click'").select("doc_id", F.col("page_no").alias("page"), "y0", F.col("part").alias("seq"), (F.col("part") % 40).cast("int").alias("num"), F.lit("question").alias("kind"))
    return extraction.detections(found, asked).select("doc_id", "page_no", "tipo", "pregunta", "parte", "png")


@query("expired_jobs", "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 7 DAY <= TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P'")
def expired_jobs(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "expired").otherwise("done").alias("status"), (F.col("o_orderdate") + F.expr("interval 7 days")).alias("expires_at"))
    return jobs.expired(o, F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query("job_latest_state", "SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) FILTER (event_type = 'purchase') AS progress FROM events GROUP BY 1")
def job_latest_state(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("status"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("progress"))
    return jobs.latest_state(e, "user_id", ["event_id"], ["status", "progress"])


@query("artifact_hash", "SELECT doc_id, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
def artifact_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


_JE = """je AS (SELECT user_id::VARCHAR AS id, event_id, ts, CASE event_id % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'done' WHEN 3 THEN 'stage' WHEN 4 THEN 'queued' ELSE 'end' END AS k FROM events),
js AS (SELECT id, event_id AS seq, CASE WHEN k IN ('running', 'failed', 'done', 'queued') THEN k END AS status, CASE k WHEN 'running' THEN 'extracting' WHEN 'stage' THEN 'classifying' WHEN 'queued' THEN 'queued' ELSE 'finalizing' END AS stage,
CASE k WHEN 'running' THEN 5 WHEN 'stage' THEN 70 WHEN 'end' THEN 90 WHEN 'queued' THEN 0 ELSE 100 END AS progress, CASE WHEN k = 'failed' THEN repeat('m' || event_id, 2000)[1:3900] END AS message, k = 'running' AS cleared,
CASE WHEN k = 'queued' THEN ts + INTERVAL 7 DAY END AS expires_at, CASE WHEN k = 'done' THEN '{"n":' || event_id || '}' END AS summary FROM je),
jb AS (SELECT id, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(stage, seq) AS stage, arg_max(progress, seq) AS progress, max(seq) FILTER (message IS NOT NULL OR cleared) AS ms, arg_max(expires_at, seq) FILTER (expires_at IS NOT NULL) AS expires_at, arg_max(summary, seq) FILTER (summary IS NOT NULL) AS summary FROM js GROUP BY id)"""


def _job_events(spark, d):
    """Events as the log of a job per user: six kinds of them make every kind of job event."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    kind = lambda k: e.where(F.col("event_id") % 6 == k)
    seq, now = F.col("event_id"), F.col("ts")
    new = {"original_filename": F.lit(None).cast("string"), "content_type": F.lit("text/pdf"), "file_size_bytes": F.lit(10)}
    parts = [
        jobs.running(kind(0), seq, now), jobs.failed(kind(1), seq, now, "PROCESSING_ERROR", F.repeat(F.concat(F.lit("m"), seq.cast("string")), 2000)),
        jobs.done(kind(2), seq, now, F.concat(F.lit('{"n":'), seq.cast("string"), F.lit("}"))), jobs.classifying(kind(3), seq), jobs.created(kind(4).withColumns(new), seq, now), jobs.finalizing(kind(5), seq),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("job_table", f"WITH {_JE} SELECT jb.id, jb.status, jb.stage, jb.progress, md5(coalesce(js.message, '')) AS error, jb.summary, strftime(jb.expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM jb LEFT JOIN js ON js.id = jb.id AND js.seq = jb.ms")
def job_table(spark, d):
    rows = jobs.jobs(_job_events(spark, d))
    return rows.select("id", "status", "stage", "progress", F.md5(F.coalesce("error_message", F.lit("")).cast("binary")).alias("error"), "summary", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"))


@query("illegal_transitions", f"""WITH {_JE}, l AS (SELECT id, seq, lag(status) OVER (PARTITION BY id ORDER BY seq) AS before, status FROM js WHERE status IS NOT NULL)
SELECT * FROM l WHERE NOT ((before IS NULL AND status = 'queued') OR (before = 'queued' AND status IN ('running', 'failed')) OR (before = 'running' AND status IN ('running', 'done', 'failed')) OR (before IN ('done', 'failed') AND status = 'running')) OR (before IS NULL AND status <> 'queued')""")
def illegal_transitions(spark, d):
    return jobs.illegal_transitions(_job_events(spark, d))


@query("job_cleanup", f"WITH {_JE}, x AS (SELECT id FROM jb WHERE expires_at <= TIMESTAMP '2024-01-20') SELECT 'event' AS kind, id AS name, 100 AS n FROM x UNION ALL SELECT 'artifact', user_id::VARCHAR, count(*)::INT FROM events WHERE event_type = 'purchase' AND user_id::VARCHAR NOT IN (SELECT id FROM x) GROUP BY ALL")
def job_cleanup(spark, d):
    found = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").cast("string").alias("name"))
    events, left, _ = jobs.clean_up(_job_events(spark, d), found, F.lit(1 << 40), F.lit("2024-01-20").cast("timestamp"))
    rows = events.select(F.lit("event").alias("kind"), F.col("id").alias("name"), F.col("progress").alias("n"))
    return rows.union(left.groupBy("job_id").agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("artifact"), "job_id", "n"))


@query("artifact_links", "SELECT user_id::VARCHAR AS job_id, string_agg(DISTINCT 'http://h/v1/jobs/' || user_id || '/artifacts/' || CASE event_id % 3 WHEN 0 THEN 'preguntas.json' ELSE 'texto_total.txt' END, ' ' ORDER BY 'http://h/v1/jobs/' || user_id || '/artifacts/' || CASE event_id % 3 WHEN 0 THEN 'preguntas.json' ELSE 'texto_total.txt' END) AS urls FROM events WHERE event_id % 3 < 2 GROUP BY user_id")
def artifact_links(spark, d):
    """Later files of a job replace its earlier ones; names that are not allowed go."""
    name = F.when(F.col("event_id") % 3 == 0, "preguntas.json").when(F.col("event_id") % 3 == 1, "texto_total.txt").otherwise("x.exe")
    files = table(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), name.alias("name")).distinct().select("*", F.lit("p").alias("path"), F.lit(1).alias("size_bytes"), F.lit(None).cast("string").alias("sha256"))
    old = files.where("name = 'x.exe'").select("*", F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return jobs.links(jobs.registered(old, files, F.current_timestamp()), "http://h/").select("job_id", F.array_join(F.map_values("artifacts"), " ").alias("urls"))


@query("timeline_union", "SELECT kind, rank, count(*) AS n FROM (SELECT event_type = 'click' AS c, 0 AS rank, event_id FROM events UNION ALL SELECT event_type = 'click', 1, event_id FROM events WHERE event_type <> 'click') JOIN (VALUES (0, 'question'), (1, 'hinge')) v(rank, kind) USING (rank) WHERE rank = 1 OR c GROUP BY ALL")
def timeline_union(spark, d):
    e = table(spark, d, "events")
    both = hierarchy.union_timeline({"question": e.where("event_type = 'click'"), "hinge": e.where("event_type <> 'click'")}, ["event_id"])
    return both.groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("extraction_summary", f"WITH {_TL} SELECT count(DISTINCT user_id) AS pages, count_if(kind = 'chapter') AS chapters, count_if(kind = 'hinge' AND chapter_no > 0) AS hinges, count_if(kind = 'question') AS questions FROM tl")
def extraction_summary(spark, d):
    k = lambda x: F.col("kind") == x
    return _timeline(spark, d).agg(F.countDistinct("user_id").alias("pages"), F.count_if(k("chapter")).alias("chapters"), F.count_if(k("hinge") & (F.col("chapter_no") > 0)).alias("hinges"), F.count_if(k("question")).alias("questions"))


_S = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}]"


def _sql_paragraphs(c: str) -> str:
    """The paragraph rule in SQL; a captured character stands in for each look-ahead."""
    steps = [("-\\n([\\p{L}\\p{N}_])", "\\1"), ("\\n" + _S + "*\\n+", "\n\x01\n"), ("\\n" + _S + "*([A-Za-z]\\)|\\p{Nd}+\\)|\\([A-Za-z0-9]+\\)|[-•])", "\n\x01\n\\1"), ("\\n+", " "), ("\x01", "\n"), ("[ \\t]{2,}", " "), ("^" + _S + "+|" + _S + "+$", "")]
    for pattern, new in steps:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return c


_QL = """ql AS (SELECT doc_id, i, regexp_replace(line, '^[\\s]+|[\\s]+$', '', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)),
qn AS (SELECT doc_id, i, CASE WHEN line = '' THEN 'x' ELSE line END AS line, (i * 3 + doc_id) % 17 + 1 AS n, (doc_id + i) % 11 AS k FROM ql),
qt AS (SELECT doc_id, string_agg(CASE k WHEN 0 THEN n || '.' || chr(10) WHEN 1 THEN '2024. ' WHEN 2 THEN '1999.' || chr(10) WHEN 3 THEN '07.' || chr(10) WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN '1950. UTC ' WHEN 7 THEN n || '.' || chr(10) || '(' ELSE n || '. ' END || line, chr(10) ORDER BY i) AS t FROM qn GROUP BY doc_id)"""


@query("question_segments", f"""WITH RECURSIVE {_QL}, p AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM qt),
c AS (SELECT *, regexp_extract(line, '^([0-9]{{1,4}})\\.(\\s|$)', 1) AS num, regexp_matches(line, '^[0-9]{{1,4}}\\.$') AS bare, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM p),
y AS (SELECT *, num <> '' AND length(num) = 4 AND num BETWEEN '1900' AND '2100' AS year FROM c),
w AS (SELECT doc_id, i, num::INT AS num, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM y WHERE num <> '' AND NOT (bare AND nx IS NULL) AND NOT (year AND regexp_matches(lower(line), 'firmado digitalmente|sellodigital|utc|fecha:|razón|razon|lugar:'))
  AND (NOT bare OR (NOT year AND NOT (length(num) >= 2 AND num[1] = '0') AND regexp_matches(nx, '^[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]')))),
r(doc_id, j, last, kept) AS (SELECT doc_id, j, num, true FROM w WHERE j = 1 UNION ALL SELECT w.doc_id, w.j, CASE WHEN r.last - w.num >= 5 THEN r.last ELSE w.num END, r.last - w.num < 5 FROM r JOIN w ON w.doc_id = r.doc_id AND w.j = r.j + 1),
s AS (SELECT w.doc_id, w.i, w.num, row_number() OVER (PARTITION BY w.doc_id ORDER BY w.i) - 1 AS seq, lead(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS nxt FROM w JOIN r ON r.doc_id = w.doc_id AND r.j = w.j WHERE r.kept),
x AS (SELECT s.doc_id, s.seq, s.num, string_agg(CASE WHEN p.i = s.i THEN regexp_replace(p.line, '^[0-9]{{1,4}}\\.\\s*', '') ELSE p.line END, chr(10) ORDER BY p.i) AS raw FROM s JOIN p ON p.doc_id = s.doc_id AND p.i >= s.i AND (s.nxt IS NULL OR p.i < s.nxt) GROUP BY ALL)
SELECT doc_id, seq::INT AS seq, num AS numero, md5({_sql_paragraphs("regexp_replace(raw, '^[ ]*[\\n]+', '')")}) AS texto FROM x""")
def question_segments(spark, d):
    """Every line of every text, numbered so that numbers rise and fall, with bare ones, years and signature years."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line, i, k = text.strip(F.col("line")), F.col("line_no"), (F.col("doc_id") + F.col("line_no")) % 11
    n = ((i * 3 + F.col("doc_id")) % 17 + 1).cast("string")
    put = F.when(k == 0, F.concat(n, F.lit(".\n"))).when(k == 1, "2024. ").when(k == 2, "1999.\n").when(k == 3, "07.\n").when(k.isin(4, 5), "").when(k == 6, "1950. UTC ").when(k == 7, F.concat(n, F.lit(".\n("))).otherwise(F.concat(n, F.lit(". ")))
    whole = lines.page_texts(rows.withColumn("line", F.concat(put, F.when(line == "", "x").otherwise(line))), ["doc_id"])
    found = questions.split_questions(whole, "doc_id")
    return found.select("doc_id", "seq", "numero", F.md5(F.col("texto").cast("binary")).alias("texto"))


_RAW = "replace(regexp_replace(replace(text, ' | ', '   '), '([^\\n]*\\n[^\\n]*\\n[^\\n]*\\n)', '\\1  \n- ', 'g'), ', ', ',' || chr(10) || 'a) ')"


def _raw_question():
    """A text with wide gaps for table rows, a blank line and a list starter after every third line, and more starters."""
    parts = F.split(F.replace("text", F.lit(" | "), F.lit("   ")), "\n")
    put = F.array_join(F.transform(parts, lambda x, i: F.when((i > 0) & (i % 3 == 0), F.concat(F.lit("  \n- "), x)).otherwise(x)), "\n")
    return F.replace(put, F.lit(", "), F.lit(",\na) "))


@query("question_format", f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, {_RAW} AS t FROM documents)),
c AS (SELECT doc_id, i, regexp_replace(line, '\\r+$', '') AS line, list_filter(regexp_split_to_array(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\s{{2,}}'), lambda x: trim(x) <> '') AS cells FROM l),
k AS (SELECT *, len(cells) >= 2 AS is_row FROM c), n AS (SELECT *, (is_row IS DISTINCT FROM lag(is_row) OVER (PARTITION BY doc_id ORDER BY i))::INT AS turn FROM k),
g AS (SELECT *, sum(turn) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM n), h AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id, b) AS widest FROM g),
o AS (SELECT doc_id, b, is_row, CASE WHEN is_row THEN string_agg(array_to_string(cells, ';') || repeat(';', (widest - len(cells))::INT), chr(10) ORDER BY i) ELSE {_sql_paragraphs("regexp_replace(string_agg(CASE WHEN trim(line) = '' THEN '' ELSE line END, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g')")} END AS t FROM h GROUP BY doc_id, b, is_row)
SELECT doc_id, md5(coalesce(regexp_replace(string_agg(t, chr(10) ORDER BY b) FILTER (t <> ''), '^\\s+|\\s+$', '', 'g'), '')) AS h FROM o GROUP BY doc_id""")
def question_format(spark, d):
    """Texts with table rows, blank lines and list starters put in, formatted as questions are."""
    raw = _raw_question()
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(questions.format_texts(raw).cast("binary")).alias("h"))


@query("question_render", """WITH q AS (SELECT o_custkey, o_orderkey, '------------' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'CAPITULO: ' || o_orderpriority || chr(10) END || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'BISAGRA: b' || chr(10) END || 'NUMERO: ' || o_orderkey || chr(10) || 't' || o_orderstatus
|| CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '  [TABLA] parte 1: x.png' || chr(10) || '  [TABLA] parte 2: y.png' ELSE '' END AS b FROM orders) SELECT o_custkey, md5(string_agg(b, chr(10) ORDER BY o_orderkey) || chr(10) || '------------' || chr(10)) AS h FROM q GROUP BY 1""")
def question_render(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    part = lambda n, p: F.struct(F.lit("tabla").alias("tipo"), F.lit(n).alias("parte"), F.lit(p).alias("png"))
    shown = F.when(k % 5 == 0, F.array(part(1, "x.png"), part(2, "y.png"))).otherwise(F.array().cast("array<struct<tipo string, parte int, png string>>"))
    q = o.select("o_custkey", k.alias("seq"), F.when(k % 3 != 0, F.col("o_orderpriority")).otherwise("").alias("capitulo"), F.when(k % 2 != 0, "b").alias("bisagra"), k.alias("numero"), F.concat(F.lit("t"), "o_orderstatus").alias("texto"), shown.alias("tablas_figuras"))
    return questions.rendered(q, "o_custkey").select("o_custkey", F.md5(F.col("text").cast("binary")).alias("h"))


@query("paragraph_normalize", f"SELECT doc_id, md5({_sql_paragraphs(_RAW)}) AS h FROM documents")
def paragraph_normalize(spark, d):
    raw = _raw_question()
    return table(spark, d, "documents").select("doc_id", F.md5(text.paragraphs(raw).cast("binary")).alias("h"))


#: Bytes of stored documents whose spans one task makes.
SPANS_FROM = 4 << 20


def _spans(spark, d):
    """Words of a document's lines as spans on a page; texts are dealt out and sorted by page, so that spans need not be."""
    docs = table(spark, d, "documents")
    n = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SPANS_FROM + 1
    docs = docs.select("doc_id", "text").repartition(n, "doc_id").sortWithinPartitions("doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).select("doc_id", "row", F.posexplode(F.split("line", " ")).alias("col", "text"))
    x, y = F.col("col") * 40.0, F.col("row") * 8.0 + F.pmod("col", F.lit(3)) * 0.5
    return docs.where("text <> ''").select("doc_id", (F.col("row") * 10000 + F.col("col")).alias("seq"), "text", x.alias("x0"), y.alias("y0"), (x + F.length("text") * 5).alias("x1"), (y + 6).alias("y1"), (F.col("row") % 4 == 0).alias("is_bold"))


@query("line_assembly")
def line_assembly(spark, d):
    return layout.assemble_lines(_spans(spark, d), ["doc_id"], together=True)


@query("bold_merge")
def bold_merge(spark, d):
    return layout.merge_bold(layout.assemble_lines(_spans(spark, d), ["doc_id"], together=True), ["doc_id"])


@query("rect_merge")
def rect_merge(spark, d):
    r = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("seq"), (F.col("l_partkey") % 200).cast("double").alias("x0"), (F.col("l_suppkey") % 50 * 4.0).alias("y0"), (F.col("l_partkey") % 200 + F.col("l_quantity")).alias("x1"), (F.col("l_suppkey") % 50 * 4.0 + 10).alias("y1"))
    return layout.merge_rects(r, ["l_orderkey"])
