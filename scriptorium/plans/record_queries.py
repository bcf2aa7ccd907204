"""Queries on sources, gates, joins, aggregates and ordered state."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import questions as Q
from ..operators import review as V
from ..session import scratch_dir, table
from ..sources import corpus as C
from .registry import query


def literal(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the status that their label gives."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return table(spark, sf, "documents").join(labels, "doc_id", "left").withColumn("status", V.status_of(F.col("quality")))


# sources and sinks


@query("src_doc_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def src_doc_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("corpus_fingerprint", """WITH h AS (SELECT sha256(doc_id || chr(31) || text) AS h FROM documents),
s AS (SELECT substr(h, 1, 3) AS s, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY s)) AS fingerprint FROM s""")
def corpus_fingerprint(spark, sf):
    return C.fingerprint(table(spark, sf, "documents"), "doc_id", "text")


@query("src_page_subset", "SELECT page_id, url, length(html) AS n FROM pages WHERE page_id IN (1, 3, 4, 5, 40)")
def src_page_subset(spark, sf):
    wanted = spark.range(1).select(F.explode(C.page_numbers(F.lit("40,3-5,1,4")).cast("array<bigint>")).alias("page_id"))
    return table(spark, sf, "pages").join(F.broadcast(wanted), "page_id").select("page_id", "url", F.length("html").cast("long").alias("n"))


_SPECS = "(VALUES ('a', '1,54-56,128'), ('b', '3'), ('c', '5-7,6-8,5')) AS t(k, spec)"


@query("src_page_spec", "SELECT * FROM (VALUES ('a', [1, 54, 55, 56, 128]), ('b', [3]), ('c', [5, 6, 7, 8])) AS t(k, pages)")
def src_page_spec(spark, sf):
    return literal(spark, _SPECS).select("k", C.page_numbers(F.col("spec")).alias("pages"))


@query("src_json_roundtrip", "SELECT doc_id, text, lang FROM documents")
def src_json_roundtrip(spark, sf):
    docs, path = table(spark, sf, "documents").select("doc_id", "text", "lang"), _scratch(spark, "json")
    C.write_corpus(docs, path)
    return C.read_corpus(spark, path, docs.schema)


@query("sink_replace_document", "SELECT lang, count(*) AS n, min(n_chars) AS least FROM (SELECT lang, CASE WHEN lang = 'fr' THEN 0 ELSE n_chars END AS n_chars FROM documents) GROUP BY lang")
def sink_replace_document(spark, sf):
    docs, path = table(spark, sf, "documents").select("doc_id", "n_chars", "lang"), _scratch(spark, "replace")
    C.replace_partitions(docs, path, "lang")
    C.replace_partitions(docs.where("lang = 'fr'").withColumn("n_chars", F.lit(0).cast("long")), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"))


@query("src_latest_run", "SELECT user_id, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def src_latest_run(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("user_id", "event_id")


@query("run_latest_per_document", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def run_latest_per_document(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m")).select("user_id", "m.event_id")


_BATCHES = "(VALUES ('b.json', 3, 'r1', 'approved'), ('a.json', 5, 'r1', 'rejected'), ('a.json', 5, 'r2', 'approved'), ('c.json', 3, 'r2', 'rejected'), ('c.json', 3, 'r9', 'approved')) AS t(file, stamp, record_id, status)"


@query("rev_batches_ordered", f"SELECT file, stamp, row_number() OVER (ORDER BY stamp, file) AS n FROM (SELECT DISTINCT file, stamp FROM {_BATCHES})")
def rev_batches_ordered(spark, sf):
    return literal(spark, _BATCHES).select("file", "stamp").distinct().withColumn("n", F.row_number().over(Window.orderBy("stamp", "file")))


@query("rev_latest_wins", "SELECT doc_id, CASE WHEN d.status IS NOT NULL THEN d.status ELSE 'pending' END AS status FROM documents LEFT JOIN (SELECT user_id, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'approved' END AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) d ON user_id = doc_id")
def rev_latest_wins(spark, sf):
    made = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "ts", "event_id", F.when(F.col("event_type") == "error", "rejected").otherwise("approved").alias("status"))
    last = V.latest(made, "doc_id", F.desc("ts"), F.desc("event_id"))
    return V.apply_decisions(table(spark, sf, "documents").select("doc_id", F.lit("pending").alias("status")), last, "doc_id")


@query("rev_unknown_ids", "SELECT DISTINCT user_id AS doc_id FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)")
def rev_unknown_ids(spark, sf):
    return V.unknown(table(spark, sf, "events").select(F.col("user_id").cast("long").alias("doc_id")), table(spark, sf, "labels"), "doc_id")


@query("rev_routed", "SELECT event_id, user_id AS doc_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def rev_routed(spark, sf):
    return V.routed(table(spark, sf, "events").select("event_id", F.col("user_id").cast("long").alias("doc_id")), table(spark, sf, "labels").where("quality = 1"), "doc_id")


@query("mig_pending", "SELECT * FROM (VALUES (2, 'changed'), (3, 'pending')) AS t(version, state)")
def mig_pending(spark, sf):
    files = literal(spark, "(VALUES (1, 'aa'), (2, 'bb'), (3, 'cc')) AS t(version, checksum)")
    applied = literal(spark, "(VALUES (1, 'aa'), (2, 'xx')) AS t(version, done)")
    both = files.join(applied, "version", "left")
    return both.where("done is null or done <> checksum").select("version", F.when(F.col("done").isNull(), "pending").otherwise("changed").alias("state"))


@query("exp_review_payload", """SELECT doc_id, '{"source":"' || source || '","lang":"' || lang || '","n_chars":' || n_chars || '}' AS payload FROM documents""")
def exp_review_payload(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "source", "lang", "n_chars").dropFields("doc_id")).alias("payload"))


# gates and checks

_REC = "rec AS (SELECT doc_id, lang, source, CASE quality WHEN 1 THEN 'approved' WHEN 0 THEN 'rejected' ELSE 'pending' END AS status FROM documents LEFT JOIN labels USING (doc_id))"


@query("gate_approved", f"WITH {_REC} SELECT doc_id FROM rec WHERE status = 'approved'")
def gate_approved(spark, sf):
    return V.gate(records(spark, sf)).select("doc_id")


@query("gate_preview", f"WITH {_REC} SELECT doc_id, status FROM rec WHERE status <> 'rejected'")
def gate_preview(spark, sf):
    return V.gate(records(spark, sf), preview=True).select("doc_id", "status")


@query("gate_violations", f"WITH {_REC} SELECT status, count(*) AS n FROM rec WHERE status <> 'approved' GROUP BY status")
def gate_violations(spark, sf):
    return records(spark, sf).where("status <> 'approved'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("gate_same_document", "SELECT count(DISTINCT lang) = 1 AS same, count(DISTINCT lang) AS n FROM documents")
def gate_same_document(spark, sf):
    return table(spark, sf, "documents").agg((F.countDistinct("lang") == 1).alias("same"), F.countDistinct("lang").alias("n"))


@query("corpus_counts", f"WITH {_REC} SELECT lang, count(*) AS n, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM rec GROUP BY lang")
def corpus_counts(spark, sf):
    return records(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"))


@query("dq_violations", "SELECT 'n_chars' AS rule, doc_id FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'short', doc_id FROM documents WHERE length(text) < 20 UNION ALL SELECT 'label', doc_id FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT 'orphan', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def dq_violations(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    rules = F.array_compact(F.array(F.when(F.col("n_chars") != F.length("text"), "n_chars"), F.when(F.length("text") < 20, "short")))
    return (
        d.select(F.explode(rules).alias("rule"), "doc_id")
        .union(lab.where(~F.col("quality").isin(0, 1)).select(F.lit("label"), "doc_id"))
        .union(lab.join(d, "doc_id", "left_anti").select(F.lit("orphan"), "doc_id"))
    )


@query("route_pages", "SELECT page_id, CASE WHEN page_id BETWEEN 54 AND 127 THEN 'course' WHEN page_id BETWEEN 128 AND 148 THEN 'application' WHEN page_id BETWEEN 149 AND 163 THEN 'schedule' WHEN page_id BETWEEN 172 AND 186 THEN 'fee' WHEN page_id BETWEEN 19 AND 53 OR page_id BETWEEN 164 AND 171 OR page_id = 187 THEN 'policy' END AS kind FROM pages")
def route_pages(spark, sf):
    ranges = literal(spark, "(VALUES (54, 127, 'course'), (128, 148, 'application'), (149, 163, 'schedule'), (172, 186, 'fee'), (19, 53, 'policy'), (164, 171, 'policy'), (187, 187, 'policy')) AS t(lo, hi, kind)")
    pages = table(spark, sf, "pages").select("page_id")
    return pages.join(F.broadcast(ranges), F.col("page_id").between(F.col("lo"), F.col("hi")), "left").select("page_id", "kind")


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# joins and ordered state on tables


@query("asof_last_signup", "WITH s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup') SELECT event_id, (SELECT max(s.ts) FROM s WHERE s.user_id = e.user_id AND s.ts < e.ts) AS last_signup FROM events e WHERE event_type = 'purchase'")
def asof_last_signup(spark, sf):
    # RANGE up to one microsecond before keeps equal times out
    by = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf, "events").where("event_type in ('signup', 'purchase')").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(by)
    return e.withColumn("last_signup", last.cast("timestamp_ntz")).where("event_type = 'purchase'").select("event_id", "last_signup")


@query("ffill_events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried, event_type <> 'purchase' AS inherited FROM events")
def ffill_events(spark, sf):
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf, "events").select("event_id", L.carried(own, by).alias("carried"), (F.col("event_type") != "purchase").alias("inherited"))


@query("coalesce_parents", "SELECT d.doc_id, coalesce('label:' || l.quality, 'item:' || b.item_id, 'vector:' || v.label) AS parent FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id LEFT JOIN embeddings v ON v.vec_id = d.doc_id")
def coalesce_parents(spark, sf):
    parents = (
        table(spark, sf, "labels").select("doc_id", F.lit(0).alias("o"), F.concat(F.lit("label:"), "quality").alias("p"))
        .union(table(spark, sf, "benchmark").select("item_id", F.lit(1), F.concat(F.lit("item:"), "item_id")))
        .union(table(spark, sf, "embeddings").select("vec_id", F.lit(2), F.concat(F.lit("vector:"), "label")))
    )
    first = parents.groupBy("doc_id").agg(F.min_by("p", "o").alias("parent"))
    return table(spark, sf, "documents").select("doc_id").join(first, "doc_id", "left")


@query("order_nulls_last", f"WITH {_REC} SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY quality NULLS LAST, doc_id) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def order_nulls_last(spark, sf):
    return records(spark, sf).select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.asc_nulls_last("quality"), "doc_id")).alias("n"))


@query("chunk_union", "SELECT 'document' AS kind, doc_id AS id, md5(text) AS digest FROM documents UNION ALL SELECT 'item', item_id, md5(text) FROM benchmark UNION ALL SELECT 'page', page_id, md5(html) FROM pages")
def chunk_union(spark, sf):
    part = lambda t, k, i, c: table(spark, sf, t).select(F.lit(k).alias("kind"), F.col(i).alias("id"), F.md5(c).alias("digest"))
    return part("documents", "document", "doc_id", "text").unionByName(part("benchmark", "item", "item_id", "text")).unionByName(part("pages", "page", "page_id", "html"))


@query("ids_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def ids_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").exceptAll(table(spark, sf, "labels").select("doc_id")).distinct()


@query("concat_lines", "SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def concat_lines(spark, sf):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(lines, "\n")).alias("digest"), F.count(F.lit(1)).alias("turns"))


@query("argmax_table", "SELECT source, arg_max(doc_id, n_chars * 1000000000 - doc_id) AS doc_id FROM documents GROUP BY source")
def argmax_table(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("doc_id"))


@query("singleton_code", "SELECT source, CASE WHEN count(DISTINCT lang) = 1 THEN min(lang) END AS code FROM documents GROUP BY source")
def singleton_code(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.when(F.countDistinct("lang") == 1, F.min("lang")).alias("code"))


_PACK = """WITH RECURSIVE l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
n AS (SELECT doc_id, ls, list_transform(ls, lambda x: len(list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> ''))) AS ns FROM l),
r AS (SELECT doc_id, ls, ns, 0 AS i, 0::BIGINT AS used, 0 AS chunk FROM n
 UNION ALL SELECT doc_id, ls, ns, i + 1, CASE WHEN i > 0 AND used + ns[i + 1] <= 60 THEN used + ns[i + 1] ELSE ns[i + 1] END, CASE WHEN i > 0 AND used + ns[i + 1] <= 60 THEN chunk ELSE chunk + 1 END FROM r WHERE i < len(ls))
SELECT doc_id, CAST(max(chunk) AS BIGINT) AS chunks, CAST(max(used) AS BIGINT) AS most FROM r GROUP BY doc_id"""


@query("pack_lines", _PACK)
def pack_lines(spark, sf):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    packed = table(spark, sf, "documents").select("doc_id", lines.alias("ls")).select("doc_id", L.pack_lines(F.col("ls"), 60).alias("cs"))
    count = lambda c: F.size(F.array_remove(F.split(c, "[\\x20\\x09-\\x0D]+", -1), ""))
    return packed.select("doc_id", F.size("cs").cast("long").alias("chunks"), F.coalesce(F.array_max(F.transform("cs", count)), F.lit(0)).cast("long").alias("most"))


@query("token_overlap", f"""WITH p AS (SELECT a.item_id AS a, b.item_id AS b, list_distinct({T.tokens_sql('a.text')}) AS x, list_distinct({T.tokens_sql('b.text')}) AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / greatest(least(len(x), len(y)), 1), 9) AS overlap FROM p""")
def token_overlap(spark, sf):
    b = table(spark, sf, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("a"), F.col("item_id").alias("b"), F.col("text").alias("t2"))
    return b.join(nxt, F.col("item_id") == F.col("a")).select("a", "b", F.round(L.token_overlap(F.col("text"), F.col("t2")), 9).alias("overlap"))


# scalar functions on tables


@query("tokenize", f"SELECT doc_id, md5(array_to_string({T.tokens_sql('text')}, ' ')) AS digest FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("digest"))


@query("clean_text", "SELECT doc_id, md5(trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) AS digest FROM documents")
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("slug", "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12) AS slug FROM part")
def slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.slug(F.col("p_name"), 12).alias("slug"))


@query("preview", """WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 80), ' [^ ]*$', '')) || '…' END AS preview FROM c""")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text"), 80).alias("preview"))


def level_of(lang: Column) -> Column:
    """Study level by the first letter; letters of languages stand in for those of printed pages."""
    levels = F.create_map(*[F.lit(x) for kv in (("E", "undergraduate"), ("F", "postgraduate"), ("D", "diploma")) for x in kv])
    return F.coalesce(F.try_element_at(levels, F.upper(F.substring(lang, 1, 1))), F.lit("other"))


@query("level_by_prefix", "SELECT doc_id, CASE upper(substr(lang, 1, 1)) WHEN 'E' THEN 'undergraduate' WHEN 'F' THEN 'postgraduate' WHEN 'D' THEN 'diploma' ELSE 'other' END AS level FROM documents")
def level_by_prefix(spark, sf):
    return table(spark, sf, "documents").select("doc_id", level_of(F.col("lang")).alias("level"))


@query("overclaim_flags", "SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(?:you are|you''re) (?:definitely |fully )?eligible\\b|\\b(?:guaranteed|certainly) (?:admission|eligible|admitted)\\b') AS flagged FROM conversations WHERE role = 'assistant'")
def overclaim_flags(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.overclaims(F.col("text")).alias("flagged"))


@query("route_mode", "SELECT conv_id, turn, regexp_matches(text, '(?i)\\b(?:which|what|suggest|recommend|list)\\b.*\\b(?:courses?|programmes?|programs?|options?)\\b') AS discovery FROM conversations WHERE role = 'user'")
def route_mode(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.is_discovery(F.col("text")).alias("discovery"))


@query("query_intents", "WITH c AS (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{n}' END" for n, p, _ in Q.INTENTS) + "], lambda x: x IS NOT NULL) AS i FROM conversations WHERE role = 'user') SELECT conv_id, turn, array_to_string(CASE WHEN len(i) > 0 THEN i ELSE ['general'] END, ',') AS intents FROM c")
def query_intents(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(Q.intents(F.col("text")), ",").alias("intents"))
