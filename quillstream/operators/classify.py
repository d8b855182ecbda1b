"""Weighted topic scores of questions by a user-supplied taxonomy table.

questions: id column, chapter, hinge, text (null zones are empty). taxonomy: topic_pos, topic_id, topic_name, kw_pos,
keyword; an entry counts once however often it occurs, repeated entries count each, blank ones never. Keywords of up to
four letters match whole words. Topics with equal scores keep the order of topic_pos.

All zones of a question are in one row, so scoring is one projection without a shuffle: each zone is folded once, every
distinct keyword is looked up in it once, and entries read their keyword's place in the result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCORES, UNCLASSIFIED, Scores
from ..functions.text import as_words, fold, let

ZONES = ("chapter", "hinge", "text")
#: Names of the zones in the detail output.
NAMES = {"chapter": "capitulo", "hinge": "bisagra", "text": "texto"}
#: Entries that a taxonomy may have; it becomes a literal of the plan, so larger tables are refused.
MOST_ENTRIES = 100_000


def entries(taxonomy: DataFrame, most: int = MOST_ENTRIES) -> tuple[list[dict], list[str]]:
    """Topics in order with their entries (keyword, number of its folded form), and the distinct folded forms."""
    rows = taxonomy.withColumn("folded", fold(F.col("keyword"))).where("folded <> ''").orderBy("topic_pos", "kw_pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"taxonomy has more than {most} entries")
    forms: dict[str, int] = {}
    topics: dict[tuple, dict] = {}
    for r in rows:
        topic = topics.setdefault((r.topic_pos, r.topic_id, r.topic_name), {"topic_pos": r.topic_pos, "topic_id": r.topic_id, "topic_name": r.topic_name, "e": []})
        topic["e"].append({"k": r.keyword, "i": forms.setdefault(r.folded, len(forms)) + 1})
    return list(topics.values()), list(forms)


def _found(zone: Column, forms: list[str], short: int) -> Column:
    """Per distinct folded keyword whether the zone holds it."""

    def test(z):
        long = lambda k: F.contains(z["t"], k)
        return F.transform(F.lit(forms), lambda k: F.when(F.length(k) <= short, F.contains(z["w"], F.concat(F.lit(" "), k, F.lit(" ")))).otherwise(long(k)))

    return let(let(fold(zone), lambda t: F.struct(t.alias("t"), as_words(t).alias("w"))), test)


def with_topics(questions: DataFrame, taxonomy: DataFrame, scores: Scores = SCORES) -> DataFrame:
    """questions with temas: topics at or above the least score, highest first (topic_pos, topic_id, topic_name, score,
    matches and, by zone, detalle)."""
    topics, forms = entries(taxonomy)
    if not topics:
        none = "array<struct<topic_pos int, topic_id string, topic_name string, score double, matches array<string>, detalle struct<capitulo array<string>, bisagra array<string>, texto array<string>>>>"
        return questions.withColumn("temas", F.array().cast(none))
    table = F.from_json(F.lit(json.dumps(topics)), "array<struct<topic_pos int, topic_id string, topic_name string, e array<struct<k string, i int>>>>")
    weights = dict(zip(ZONES, (scores.chapter, scores.hinge, scores.text)))

    def scored(hits):
        def held(t, zones):
            """Keywords of the topic's entries that stand in one of the zones."""

            def found(e):
                out = F.lit(False)
                for z in zones:
                    out = out | F.element_at(hits[z], e["i"])
                return out

            return F.transform(F.filter(t["e"], found), lambda e: e["k"])

        def topic(t):
            parts = F.struct(*(held(t, [z]).alias(NAMES[z]) for z in ZONES))
            return let(parts, lambda d: F.struct(
                sum((F.size(d[NAMES[z]]) * F.lit(float(weights[z])) for z in ZONES), F.lit(0.0)).alias("score"), t["topic_pos"].alias("topic_pos"), t["topic_id"].alias("topic_id"),
                t["topic_name"].alias("topic_name"), held(t, ZONES).alias("matches"), d.alias("detalle"),
            ))

        kept = F.filter(F.transform(table, topic), lambda t: t["score"] >= scores.least)
        ranked = F.array_sort(F.transform(kept, lambda t: F.struct((-t["score"]).alias("r"), t["topic_pos"].alias("p"), t.alias("t"))))
        return F.transform(ranked, lambda x: x["t"])

    hits = F.struct(*(_found(F.col(z), forms, scores.short).alias(z) for z in ZONES))
    temas = let(hits, scored)
    order = ("topic_pos", "topic_id", "topic_name", "score", "matches", "detalle")
    return questions.withColumn("temas", F.transform(temas, lambda t: F.struct(*(t[f].alias(f) for f in order))))


def topic_scores(questions: DataFrame, taxonomy: DataFrame, key: str, scores: Scores = SCORES) -> DataFrame:
    """key, topic_pos, topic_id, topic_name, score, matches of topics at or above the least score."""
    return with_topics(questions, taxonomy, scores).select(key, F.explode("temas").alias("t")).select(key, "t.topic_pos", "t.topic_id", "t.topic_name", "t.score", "t.matches")


def _main(scores: Scores):
    """Topics within the share of the top, and the others whose name is none of theirs."""
    main = F.filter("temas", lambda t: t["score"] >= F.greatest(F.lit(scores.least), F.lit(scores.share) * F.get("temas", F.lit(0))["score"]))
    return main, F.filter("temas", lambda t: ~F.array_contains(F.transform(F.col("__main"), lambda m: m["topic_name"]), t["topic_name"]))


def classify(questions: DataFrame, taxonomy: DataFrame, key: str | list[str], scores: Scores = SCORES, also: tuple = ()) -> DataFrame:
    """One row per question: primary topic, all primaries within the share of the top, three secondaries, evidence.

    temas_secundarios_score goes with temas_secundarios; temas holds every topic with its matches by zone. also: further
    columns of questions to keep.
    """
    keys = [key] if isinstance(key, str) else list(key)
    main, others = _main(scores)
    rows = with_topics(questions.select(*dict.fromkeys([*keys, *ZONES, *also])), taxonomy, scores).withColumn("__main", main).withColumn("__second", F.slice(others, 1, 3))
    first = F.get("temas", F.lit(0))
    of = lambda c, f: F.transform(c, lambda t: t[f])
    detail = F.transform("temas", lambda t: F.struct(t["topic_id"].alias("id"), t["topic_name"].alias("nombre"), t["score"].alias("score"), t["matches"].alias("matches"), t["detalle"].alias("detalle")))
    return rows.select(
        *keys,
        *also,
        F.coalesce(first["topic_name"], F.lit(UNCLASSIFIED[0])).alias("tema_principal"),
        F.coalesce(first["topic_id"], F.lit(UNCLASSIFIED[1])).alias("tema_principal_id"),
        of("__main", "topic_name").alias("temas_principales"),
        of("__main", "topic_id").alias("temas_principales_id"),
        F.coalesce(first["score"], F.lit(0.0)).alias("score"),
        of("__second", "topic_name").alias("temas_secundarios"),
        of("__second", "score").alias("temas_secundarios_score"),
        F.coalesce(F.slice(first["matches"], 1, 10), F.array().cast("array<string>")).alias("keywords_match"),
        detail.alias("temas"),
    )


def classify_questions(questions: DataFrame, taxonomy: DataFrame, scores: Scores = SCORES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outputs of a run over questions (doc_id, seq, capitulo, bisagra, numero, texto, tablas_figuras).

    The classified records, their details with every topic, and one row of total, classified and unclassified.
    """
    zones = questions.withColumns({"chapter": F.col("capitulo"), "hinge": F.col("bisagra"), "text": F.col("texto")})
    rows = classify(zones, taxonomy, ["doc_id", "seq"], scores, ("numero", "capitulo", "bisagra", "texto", "tablas_figuras"))
    second = F.zip_with("temas_secundarios", "temas_secundarios_score", lambda n, s: F.struct(n.alias("nombre"), s.alias("score")))
    head = ["doc_id", "seq", "numero", "capitulo", "bisagra", "tema_principal", "tema_principal_id", "temas_principales", "temas_principales_id"]
    out = rows.select(*head, "score", second.alias("temas_secundarios"), "keywords_match", "texto", "tablas_figuras")
    return out, rows.select(*head, "temas"), summary(rows)


def summary(classified: DataFrame) -> DataFrame:
    """total, classified, unclassified."""
    none = F.col("tema_principal_id") == UNCLASSIFIED[1]
    return classified.agg(F.count(F.lit(1)).alias("total"), F.count_if(~none).alias("classified"), F.count_if(none).alias("unclassified"))


def distribution(classified: DataFrame) -> DataFrame:
    """tema_principal, n."""
    return classified.groupBy("tema_principal").agg(F.count(F.lit(1)).alias("n"))
