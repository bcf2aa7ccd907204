"""Secret scanning with multipart credential linking.

Base patterns give spans on their own. Weaker candidates (account names,
secrets under vaguer keys, service addresses) say little alone: an interval
join of the parts within a scope of ``scope`` characters reports an account
name only beside a secret, a weak secret only beside an account name or access
identifier, and an address only beside both.

Matches and the text between them come from the regular expression engine in
one order, so their lengths add up to places in code points. Everything is a
column expression; only documents with complementary parts enter the join, in
buckets as wide as a scope, each in all that it reaches, so a long document's
parts meet near ones alone.

Defined results: null or empty texts have no spans; repeated rows get equal
results; rows that share an id are told apart by their text; a null id is an id
of its own; matches of one text, however long, are placed in blocks, so work
stays near linear in them; an empty table gives an empty result; input columns
may have any name, and those that carry the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import inner_name, shielded, whole

#: kind, pattern, role, test of the matched text. Roles: I identifier, S secret, E endpoint. Fixed values.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
ACCOUNT = "(?i)(?<![A-Za-z0-9])(user(?:name)?|login|client_?id|account|access_?key_?id)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9._@-]{3,})"
WEAK_SECRET = "(?i)(?<![A-Za-z0-9])(pass|pwd|auth|client_?secret|private_?key|access_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})"
ENDPOINT = "(?i)(?<![A-Za-z0-9])(?:https?|ftp|ssh|amqp|redis|mongodb|mysql|postgres(?:ql)?)://[^\\x00-\\x20\"'<>]+"

_SPAN = "array<struct<start:int,end:int,value:string>>"
_BLOCK = 256
BASE = ("assign", "access", "hex")


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points."""
    pieces = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    empty = F.array().cast(_SPAN)

    def step(a: Column, x: Column) -> Column:
        # full blocks are set aside, so an append copies one block at most
        start = a["at"] + x["gap"]
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")))
        full = F.size(a["block"]) >= _BLOCK
        return F.struct(
            end.alias("at"),
            F.when(full, one).otherwise(F.concat(a["block"], one)).cast(_SPAN).alias("block"),
            F.when(full, F.concat(a["done"], F.array(a["block"]))).otherwise(a["done"]).cast(f"array<{_SPAN}>").alias("done"),
        )

    zero = F.struct(F.lit(0).alias("at"), empty.alias("block"), F.array().cast(f"array<{_SPAN}>").alias("done"))
    placed = F.aggregate(pairs, zero, step, lambda a: F.flatten(F.concat(a["done"], F.array(a["block"]))))
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(empty)


def base_spans(df: DataFrame, text: str) -> DataFrame:
    """Add ``__assign``, ``__access`` and ``__hex``, with matches that fail their test gone."""
    t = F.col("__t")
    df = df.withColumn("__t", whole(F.col(text)))
    df = df.select("*", spans_of(t, ASSIGN).alias("__assign"), spans_of(t, ACCESS).alias("__access"), spans_of(t, HEX).alias("__hex"))
    long_value = lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 6
    return df.withColumn("__assign", F.filter("__assign", long_value))


def _parts(column: str, role: str, weak: bool, kind: str) -> Column:
    return F.transform(
        column,
        lambda x: F.struct(F.lit(role).alias("role"), F.lit(weak).alias("weak"), F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")),
    )


def _ranked(kind: str, k: int) -> Column:
    return F.transform(f"__{kind}", lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Weak parts with their complements in scope, one array of spans for each document."""
    # spans meet in every bucket that both reach, and count in the first of these
    parts = parts.withColumn("first", F.expr(f"start div {scope}"))
    near = parts.select("id", "hash", "role", "start", "end", F.expr(f"(start - {scope}) div {scope}").alias("first"), F.expr(f"explode(sequence((start - {scope}) div {scope}, (end + {scope}) div {scope}))").alias("bucket"))
    near = near.toDF("n_id", "n_hash", "n_role", "n_start", "n_end", "n_first", "n_bucket")
    apart = F.greatest(F.col("n_start") - F.col("end"), F.col("start") - F.col("n_end"))
    met = parts.where("weak").withColumn("bucket", F.expr(f"explode(sequence(first, end div {scope}))")).join(
        near,
        F.col("id").eqNullSafe(F.col("n_id"))
        & (F.col("hash") == F.col("n_hash"))
        & (F.col("bucket") == F.col("n_bucket"))
        & (F.col("bucket") == F.greatest("first", "n_first"))
        & (F.col("role") != F.col("n_role"))
        & (apart <= scope),
    )
    roles = met.groupBy("id", "hash", "kind", "role", "start", "end").agg(F.collect_set("n_role").alias("with"))
    has = lambda r: F.array_contains("with", r)
    good = ((F.col("role") == "I") & has("S")) | ((F.col("role") == "S") & has("I")) | ((F.col("role") == "E") & has("S") & has("I"))
    return roles.where(good).groupBy("id", "hash").agg(F.collect_set(F.struct("start", F.lit(9).alias("k"), "kind", "end")).alias("__linked"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = 300) -> DataFrame:
    """All input columns, ``n_assign``, ``n_access``, ``n_hex``, ``n_linked``, ``base_sha256``, ``span_list`` and ``spans``."""
    own_id, own_text = inner_name(df, id_col), inner_name(df, text)
    df, back = shielded(df, ["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "span_list", "spans"])
    keep = df.columns
    t = F.col("__t")
    out = base_spans(df, own_text).select("*", spans_of(t, ACCOUNT).alias("__account"), spans_of(t, WEAK_SECRET).alias("__weak"), spans_of(t, ENDPOINT).alias("__endpoint"))
    out = out.withColumn("__hash", F.xxhash64("__t"))
    n_i = F.size("__account") + F.size("__access")
    n_s = F.size("__assign") + F.size("__hex") + F.size("__weak")
    weak = F.size("__account") + F.size("__weak") + F.size("__endpoint")
    linkable = out.where((weak > 0) & (n_i > 0) & (n_s > 0))
    parts = linkable.select(
        F.col(own_id).alias("id"),
        F.col("__hash").alias("hash"),
        F.explode(
            F.concat(
                _parts("__account", "I", True, "account"),
                _parts("__access", "I", False, "access"),
                _parts("__assign", "S", False, "assign"),
                _parts("__hex", "S", False, "hex"),
                _parts("__weak", "S", True, "weak_secret"),
                _parts("__endpoint", "E", True, "endpoint"),
            )
        ).alias("p"),
    ).select("id", "hash", "p.*").distinct()
    linked = _linked(parts, scope).withColumnsRenamed({"id": "__id", "hash": "__of"})

    base = F.array_sort(F.concat(*[_ranked(kind, k) for k, kind in enumerate(BASE)]))
    narrow = out.select(*keep, "__hash", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], base.alias("__base"))
    narrow = narrow.join(linked, F.col(own_id).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")), "left")
    show = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    both = F.when(F.col("__linked").isNull(), F.col("__base")).otherwise(F.array_sort(F.concat("__base", "__linked")))
    return narrow.withColumn("span_list", both).select(
        *back,
        *[f"n_{k}" for k in BASE],
        F.coalesce(F.size("__linked"), F.lit(0)).cast("long").alias("n_linked"),
        F.sha2(show(F.col("__base")), 256).alias("base_sha256"),
        "span_list",
        show(F.col("span_list")).alias("spans"),
    )
