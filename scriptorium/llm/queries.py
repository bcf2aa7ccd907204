"""The queries of this subpackage and their DuckDB twins.

Each query is thin: it reads whole tables, calls one operator with production
parameters and selects the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import decontaminate, jaccard, licences, mixing, pii, quality, repeats, secrets, shards, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@_query("op8_line_first_cleaning")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "n_lines", "n_failed_lines")


ORACLES["op8_line_first_cleaning"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS x FROM w),
lm AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
        len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n,
        length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS sy,
        length(regexp_replace(x, '[^|»›•]+', '', 'g')) AS bars,
        length(regexp_replace(x, '[^\p{L}]+', '', 'g')) AS le,
        length(regexp_replace(x, '[^\p{Lu}]+', '', 'g')) AS up,
        regexp_matches(x, '(?i)all rights reserved|terms of service|terms of use|privacy policy|cookie policy|uses cookies|enable javascript|sign up for our newsletter|subscribe to our newsletter|click here to|lorem ipsum') AS frame
       FROM ln),
lv AS (SELECT doc_id, n, ((bars >= 2 AND n <= bars * 4) OR sy * 100 > chars * 10 OR (n >= 4 AND up * 100 > le * 70)
        OR (length(x) <= 160 AND frame) OR (n <= 3 AND NOT regexp_matches(x, '[.!?:;…。！？]'))) AS bad FROM lm),
la AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(n) FILTER (bad), 0) AS lost FROM lv GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
        CAST(coalesce(lost, 0) AS BIGINT) AS lost_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words * 100 <= n_words * 50) AS kept,
       lost_words, n_lines, n_failed_lines
FROM m
"""


@_query("op9_stratified_interleaving")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = shards.interleave(docs, n_shards=40)
    return out.select("doc_id", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


ORACLES["op9_stratified_interleaving"] = r"""
WITH RECURSIVE tab AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i)),
lut AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM tab),
d AS (SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 16 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS hx FROM documents),
e AS (SELECT doc_id, source, size,
        xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(size - 16), lambda j: CAST(concat('0x', substr(hx, 2 * j + 1, 2)) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32,
        md5('scriptorium:' || doc_id) AS k
      FROM d, lut),
r AS (SELECT *, coalesce('s' || source, 'n') AS st, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1 AS r,
             count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, st, k, doc_id) - 1 AS g FROM r)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(g * 40 // total AS INTEGER) AS shard,
       g - ((g * 40 // total) * total + 39) // 40 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM g
"""


@_query("op5_credential_linking")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_spans = sum((F.col(c) for c in ("n_access", "n_hex", "n_linked")), F.col("n_assign"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked", n_spans.alias("n_spans"))


def _either(*words: str) -> str:
    """Alternatives in either case of A to Z; ``(?i)`` of that engine folds more letters. An underscore is optional."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" if c == "_" else c for c in w) for w in words)


def _credentials_sql() -> str:
    """The operator's patterns for an engine without look-behind: a match of a weak kind may begin with the character before it."""
    gap = r"""["'']?\x20*[:=]\x20*["'']?"""
    edge = "(?:^|[^A-Za-z0-9])"
    assign = f"({_either('password', 'passwd', 'secret', 'token', 'api_key')}){gap}([A-Za-z0-9+/_.=-]+)"
    account = f"{edge}(?:{_either('username', 'user', 'login', 'client_id', 'account', 'access_key_id')}){gap}([A-Za-z0-9._@-]{{3,}})"
    weak = f"{edge}(?:{_either('pass', 'pwd', 'auth', 'client_secret', 'private_key', 'access_key')}){gap}([A-Za-z0-9+/_.=-]{{6,}})"
    endpoint = f"{edge}(?:{_either('https', 'http', 'ftp', 'ssh', 'amqp', 'redis', 'mongodb', 'mysql', 'postgresql', 'postgres')})://[^\\x00-\\x20\"''<>]+"
    kinds = [("assign", "S", "false", assign), ("access", "I", "false", "AKIA[A-Z0-9]{16,}"), ("hex", "S", "false", "[0-9a-f]{24,}")]
    kinds += [("account", "I", "true", account), ("weak_secret", "S", "true", weak), ("endpoint", "E", "true", endpoint)]
    parts = "\n UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, {min(k, 3)} AS k, '{role}' AS role, {weak_} AS weak, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d"
        for k, (kind, role, weak_, p) in enumerate(kinds)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({parts}),
m AS (SELECT doc_id, kind, k, role, weak, unnest(ms) AS m, unnest(ps[1 : len(ms)]) AS p, unnest(range(len(ms))) AS i FROM x WHERE len(ms) > 0),
r AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM m),
s AS (SELECT doc_id, kind, k, role, weak, e - length(m) + CASE WHEN weak AND regexp_matches(m, '^[^A-Za-z0-9]') THEN 1 ELSE 0 END AS b, e FROM r
      WHERE kind <> 'assign' OR length(regexp_extract(m, '{assign}', 2)) >= 6),
l AS (SELECT a.doc_id, a.kind, a.role, a.b, a.e, bool_or(o.role = 'S') AS s, bool_or(o.role = 'I') AS i
      FROM s a JOIN s o ON a.doc_id = o.doc_id AND a.role <> o.role AND greatest(o.b - a.e, a.b - o.e) <= 300 WHERE a.weak GROUP BY ALL),
k AS (SELECT doc_id, b, k, kind, e FROM s WHERE NOT weak
      UNION ALL SELECT doc_id, b, 3, kind, e FROM l WHERE (role = 'I' AND s) OR (role = 'S' AND i) OR (role = 'E' AND s AND i)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      count(*) FILTER (k = 3) AS n_linked, count(*) AS n_spans, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, kind, e) AS spans,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, kind, e) FILTER (k < 3) AS base FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN g USING (doc_id)
"""


ORACLES["op5_credential_linking"] = _credentials_sql()


@_query("op7_prefix_filtered_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op7_prefix_filtered_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[s + 1 : s + 10], ' ') AS g
       FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 10, 0) + 1)) AS s FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, s, array_to_string(ws[s + 1 : s + l], ' ') AS g
       FROM (SELECT doc_id, ws, l, unnest(range(len(ws) - l + 1)) AS s FROM d, lens WHERE len(ws) >= l)),
hits AS (SELECT doc_id, item_id, s, dw.l FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@_query("op10_flat_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    index = tokens.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query("op6_fixed_block_anchors")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op6_fixed_block_anchors"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1 : s + 20], ' ')) AS g
        FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS s FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later) GROUP BY doc_id),
w AS (SELECT doc_id, w, i - 1 AS i FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d)),
k AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w LEFT JOIN (SELECT doc_id, unnest(ps) AS i FROM gone) g USING (doc_id, i)
      WHERE g.i IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@_query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[s + 1 : s + 5], ' ')) AS g
       FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 5, 0) + 1)) AS s FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)
"""


@_query("op3_contextual_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context", "n_spans")


@_query("op4_licence_dice")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_matches", "licence", "spans")

#: Target weights of the labelled domains.
MIXTURE = {"quality=1 toxic=0": 0.95, "quality=0 toxic=0": 0.05}


@_query("op2_soft_membership_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), MIXTURE, relative=True).select("doc_id", "n_tokens", "domain", "rate")
