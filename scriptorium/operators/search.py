"""From questions to ranked passages, course suggestions and checked answers, for whole tables of questions.

Tables:

    passages   id, title, text, type, field_name, parent
    questions  query_id, text
    courses    parent, course_name, program_level

Questions are analysed once; BM25 and the hashed vectors each rank passages by
joins on terms and buckets, and only the candidates that either list names are
joined with their texts for boosts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import questions as Q
from . import ranking as R
from . import scan

#: Intents that a course's own passage answers. Fixed values.
PROFILE_INTENTS = ("eligibility", "age_limit", "selection", "test_paper", "intake", "duration")
PROFILE, POLICY = "course_overview", "policy_section"
# Type of passage, what a reader is told it is.
EVIDENCE = ((PROFILE, "Complete course information"), (POLICY, "Guide-wide admissions policy"), ("appendix_row", "Guide appendix record"))


def analyse(questions: DataFrame, courses: DataFrame) -> DataFrame:
    """(query_id, text, expanded, aliases, intents, preferred, names, levels, discovery); blank questions are an error.

    ``names`` are the names, in lower case, that the expanded question holds: those of its
    aliases, and course names, which meet the question on their first word.
    """
    if questions.where(F.trim(F.coalesce("text", F.lit(""))) == "").limit(1).count():
        raise ValueError("a question is blank")
    text = F.col("text")
    out = questions.select("query_id", "text", Q.expand(text).alias("expanded"), Q.alias_spans(text).alias("aliases"))
    words = out.select("query_id", T.fold(F.col("expanded")).alias("q"), F.explode(F.array_distinct(T.tokens(F.col("expanded")))).alias("word"))
    names = courses.select(T.fold(F.col("course_name")).alias("name")).distinct()
    names = names.select("name", F.get(T.tokens(F.col("name")), F.lit(0)).alias("word")).where("word is not null")
    held = words.join(names, "word").where(F.contains("q", F.col("name"))).groupBy("query_id").agg(F.collect_set("name").alias("held"))
    out = out.join(held, "query_id", "left")
    own = F.transform("aliases", lambda a: F.lower(a["full_name"]))
    return out.select(
        "query_id", "text", "expanded", "aliases",
        Q.intents(F.col("expanded")).alias("intents"),
        Q.preferred_fields(F.col("expanded")).alias("preferred"),
        F.array_sort(F.array_union(own, F.coalesce("held", F.array().cast("array<string>")))).alias("names"),
        T.target_levels(F.col("expanded")).alias("levels"),
        T.is_discovery(text).alias("discovery"),
    )


def _scored(passages: DataFrame) -> DataFrame:
    return passages.select("id", F.concat_ws("\n", "title", "text").alias("body"))


def lexical_scores(passages: DataFrame, analysed: DataFrame) -> DataFrame:
    return R.bm25_of(_scored(passages), analysed, "id", "body", "query_id", "expanded")


def vector_scores(passages: DataFrame, analysed: DataFrame, dims: int = 1024) -> DataFrame:
    """Inner products of the hashed vectors, by a join on the buckets that are not zero; pairs without one score nothing."""
    embed = V.hash_features(dims)
    d = _scored(passages).select("id", F.explode(embed(T.tokens(F.col("body")))).alias("x")).select("id", "x.bucket", F.col("x.weight").alias("w"))
    q = analysed.select("query_id", F.explode(embed(T.tokens(F.col("expanded")))).alias("x")).select("query_id", "x.bucket", F.col("x.weight").alias("qw"))
    return d.join(q, "bucket").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 9).alias("score"))


def _both_ranks(passages: DataFrame, analysed: DataFrame, limit: int | None, types: tuple[str, ...] | None) -> DataFrame:
    """Both lists fused; statistics cover all passages, ranks those of the given types.

    One scan of the passages ranks by both, with the questions in every task; too many questions meet them in joins.
    """
    allowed = passages.where(F.col("type").isin(*types)) if types else passages
    q = scan.asked(analysed, "query_id", "expanded", R.MOST_QUESTIONS)
    if q:
        scores = scan.scored(_scored(allowed), "id", "body", q, [scan.lexical(_scored(passages), "body", q), scan.hashed(q, embedded=True)], limit)
        fused = R.fuse_lists(R.ranked(scores, limit, within=("l", "query_id")))
        return F.broadcast(fused) if limit else fused
    kept = lambda scores: scores.join(allowed.select("id"), "id", "left_semi") if types else scores
    return R.fuse(R.ranked(kept(lexical_scores(passages, analysed)), limit), R.ranked(kept(vector_scores(passages, analysed)), limit))


def search(passages: DataFrame, analysed: DataFrame, limit: int = 5, candidates: int = 40, types: tuple[str, ...] | None = None) -> DataFrame:
    """The best passages of each question: query_id, id, place, score, lrank, vrank, and each boost."""
    if limit < 1 or candidates < 1:
        raise ValueError("limit and candidates must be at least 1")
    asked = analysed.select("query_id", "expanded", "intents", "preferred", "names")
    rows = _both_ranks(passages, analysed, candidates, types).join(passages.select("id", "type", "field_name", "text"), "id").join(asked, "query_id")
    body = T.fold(F.col("text"))
    named = F.exists("names", lambda n: F.contains(body, n))
    wanted = F.coalesce(F.array_contains("preferred", F.col("field_name")), F.lit(False))
    profile = (F.col("type") == PROFILE) & named & F.arrays_overlap("intents", F.array(*[F.lit(x) for x in PROFILE_INTENTS]))
    exact = ((F.size("preferred") == 0) | wanted) & Q.exact_value(F.col("expanded"), F.col("text"))
    no = F.lit(False)
    parts = {"intent_boost": R.boosts(wanted | profile, no, no, no), "exact_boost": R.boosts(no, exact, no, no), "name_boost": R.boosts(no, no, named, no)}
    rows = rows.withColumns(parts).withColumn("score", F.round(F.col("fused") + F.col("intent_boost") + F.col("exact_boost") + F.col("name_boost"), 12))
    return R.top(rows, limit, "score").select("query_id", "id", "place", "score", "lrank", "vrank", "lscore", "vscore", *parts)


def discover(passages: DataFrame, analysed: DataFrame, courses: DataFrame, limit: int = 5) -> DataFrame:
    """The best courses of each question by their own passage: query_id, id, parent, place, score, level_boost."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = _both_ranks(passages, analysed, None, (PROFILE,)).join(passages.select("id", "parent"), "id").join(courses.select("parent", "program_level"), "parent")
    rows = rows.join(analysed.select("query_id", "levels"), "query_id")
    no = F.lit(False)
    rows = rows.withColumn("level_boost", R.boosts(no, no, no, F.array_contains("levels", F.col("program_level"))))
    rows = rows.withColumn("score", F.round(F.col("fused") + F.col("level_boost"), 12))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fused"), F.coalesce("lscore", F.lit(0.0)).desc(), F.coalesce("vscore", F.lit(0.0)).desc(), "id")
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= limit).select("query_id", "id", "parent", "place", "score", "level_boost")


def contexts(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, sources, context) from hits (query_id, id, place): numbered blocks in their order."""
    told = F.coalesce(*[F.when(F.col("type") == k, F.lit(v)) for k, v in EVIDENCE], F.lit("Guide evidence"))
    block = F.concat(F.lit("[SOURCE "), F.col("place").cast("string"), F.lit("]\nTitle: "), "title", F.lit("\nEvidence type: "), told, F.lit("\nContent:\n"), "text")
    made = hits.join(passages.select("id", "title", "type", "text"), "id").select("query_id", "place", "id", block.alias("block"))
    rows = made.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "block"))).alias("rows"))
    return rows.select("query_id", F.transform("rows", lambda x: x["id"]).alias("sources"), F.array_join(F.transform("rows", lambda x: x["block"]), "\n\n").alias("context"))


def ask(
    passages: DataFrame,
    courses: DataFrame,
    questions: DataFrame,
    generate: Callable[[Column, Column], Column],
    repair: Callable[[Column, Column, Column, str], Column] | None = None,
    limit: int | None = None,
    policy_limit: int = 2,
) -> DataFrame:
    """Each question's mode, sources, context, answer and what its check says.

    ``generate(question, context)`` and ``repair(question, context, answer, reason)`` are column functions, so a
    model is a vectorised function of the caller's. An answer that claims too much, or whose citations are missing
    or point nowhere, is repaired once.
    """
    if policy_limit < 0:
        raise ValueError("policy_limit must not be negative")
    analysed = analyse(questions, courses)
    found = search(passages, analysed.where("not discovery"), limit or 1).select("query_id", "id", F.lit(0).alias("l"), "place")
    found = found.union(discover(passages, analysed.where("discovery"), courses, limit or 3).select("query_id", "id", F.lit(0), "place"))
    if policy_limit:
        found = found.union(search(passages, analysed, policy_limit, types=(POLICY,)).select("query_id", "id", F.lit(1), "place"))
    once = found.groupBy("query_id", "id").agg(F.min(F.struct("l", "place")).alias("at"))
    hits = once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "id", "place")
    out = analysed.select("query_id", "text", "discovery").join(contexts(hits, passages), "query_id", "left")
    out = out.select("query_id", "text", "discovery", F.coalesce("sources", F.array().cast(out.schema["sources"].dataType)).alias("sources"), F.coalesce("context", F.lit("")).alias("context"))
    out = out.withColumn("answer", generate(F.col("text"), F.col("context")))
    out = out.withColumn("claims_repaired", F.col("discovery") & T.overclaims(F.col("answer")))
    if repair:
        out = out.withColumn("answer", F.when(F.col("claims_repaired"), repair(F.col("text"), F.col("context"), F.col("answer"), "claims")).otherwise(F.col("answer")))
    out = checked(out)
    bad = (F.size("invalid") > 0) | (F.col("needs") & (F.size("valid") == 0))
    out = out.withColumn("citations_repaired", bad)
    if repair:
        out = out.withColumn("answer", F.when(F.col("citations_repaired"), repair(F.col("text"), F.col("context"), F.col("answer"), "citations")).otherwise(F.col("answer")))
        out = checked(out.drop("valid", "invalid", "needs"))
    warning = F.when(F.size("invalid") > 0, F.concat(F.lit("cites sources that are not there: "), F.array_join("invalid", ", "))).when(
        F.col("needs") & (F.size("valid") == 0), F.lit("cites no source")
    )
    mode = F.when(F.col("discovery"), "course_discovery").otherwise("hybrid_retrieval")
    return out.select("query_id", mode.alias("mode"), "sources", "context", "answer", "valid", "invalid", "claims_repaired", "citations_repaired", warning.alias("warning"))


def checked(answers: DataFrame) -> DataFrame:
    """Add the cited sources that exist (valid), those that don't (invalid), and whether citations are called for."""
    n = F.size("sources")
    needs = (n > 0) & ~F.contains(F.lower("answer"), F.lit("evidence is insufficient"))
    return answers.select("*", T.valid_citations(F.col("answer"), n).alias("valid"), T.invalid_citations(F.col("answer"), n).alias("invalid"), needs.alias("needs"))
