"""Secret scans with multipart credential linking, in DataFrame functions only.

Spans that stand alone (keyword assignments, access identifiers, long hexadecimal runs) are always reported. Weak
candidates, that is identifiers, secret-like strings and endpoints that mean little alone, are reported only if
complementary parts stand near: parts are joined by interval within one text, an identifier and an endpoint each with a
secret, a weak secret with an identifier. The interval join is a range frame over the parts of a text, so
a part counts its neighbours and no pairs are made."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, text_or_empty

#: The kinds reported alone. Their order is that of spans which start together.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"  # [0-9a-f]+ of 16 characters or more
LEAST_VALUE = 12

#: Weak kinds: an identifier too short or of another family, a mixed run of 40 characters, an endpoint.
WEAK_ID = r"\b(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{8,}\b"
WEAK_SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])(?=[A-Z0-9+/]{0,39}[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
ENDPOINT = r"\b(?:https?|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[A-Za-z0-9._~:@-]{4,}"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
#: A scope: parts whose starts are this many code points apart at most.
SCOPE = 200

#: What a text must hold, in small letters for the first kind, before a pattern is worth running over it.
HOLDS = {"assign": ("passw", "secret", "token", "api"), "access": ("AKIA",), "weak_id": ("AKIA", "ASIA", "AROA", "AIDA"), "endpoint": ("://",)}

#: A match: its kind, how many code points it stands after the match before it, and its length.
MATCH = "array<struct<order:int,nth:int,skip:int,n:int,kept:boolean>>"


def _matches(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches of a kind. What stands between them is split off, so that a running sum gives their places."""
    lit = F.lit(pattern)
    found, between = F.regexp_extract_all(text, lit, F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, lit, F.lit(value_group))
    zipped = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), values.alias("v"))
    least = LEAST_VALUE if value_group else 0
    told = F.transform(zipped, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("order"), i.alias("nth"), F.char_length(x["b"]).alias("skip"), F.char_length(x["m"]).alias("n"), (F.char_length(x["v"]) >= least).alias("kept")))
    worth = F.regexp_like(text, lit)
    if kind in HOLDS:
        held = F.lower(text) if kind == "assign" else text
        worth = reduce(Column.__or__, [F.contains(held, F.lit(word)) for word in HOLDS[kind]]) & worth
    return F.when(worth, told.cast(MATCH)).otherwise(F.array().cast(MATCH))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``df``: id, spans (array of start, order, kind, end; sorted by start, then kind).

    Starts and ends are code points, the end exclusive. Null and empty texts have no spans. Repeated rows each
    have a row, whatever their ids; null ids stay null. An empty table gives no rows. Other columns are not
    read. A very long text is scanned whole."""
    docs = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    # the number stays in one shuffle: it only holds a row's own parts together
    return _linked(docs.select("id", F.monotonically_increasing_id().alias("row"), _all_matches(F.col("text")).alias("matches")), scope).select(F.col("id").alias(id_col), "spans")


def _all_matches(text: Column) -> Column:
    return F.concat(_matches(text, "assign", ASSIGN, 2), *[_matches(text, k, p) for k, p in (("access", ACCESS), ("hex", HEX), ("weak_id", WEAK_ID), ("weak_secret", WEAK_SECRET), ("endpoint", ENDPOINT))])


def _linked(numbered: DataFrame, scope: int) -> DataFrame:
    """id and spans of each row of (id, row, matches): a window for each row, over its parts alone."""
    each = numbered.select("id", "row", F.explode_outer("matches").alias("m")).select("id", "row", "m.*").repartition("row")
    so_far = Window.partitionBy("row", "order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = each.withColumn("end", F.sum(F.col("skip") + F.col("n")).over(so_far).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    # a match that failed stays as a row without a kind: its text still has to be answered for
    each = ends.select("id", "row", (F.col("end") - F.col("n")).alias("start"), "order", F.when(F.col("kept"), kind).alias("kind"), "end")
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-scope, scope)
    # a part is not its own complement: where a weak kind lies on a strong one, it is that one
    has = lambda *kinds: F.max(F.col("kind").isin(*kinds)).over(near)
    identifier, secret = has("access", "weak_id"), has("assign", "weak_secret")
    linked = F.when(F.col("order") < 3, F.col("kind").isNotNull()).when(F.col("kind") == "weak_id", secret).when(F.col("kind") == "weak_secret", identifier).when(F.col("kind") == "endpoint", secret & identifier)
    spans = F.array_sort(F.collect_list(F.when(F.col("linked"), F.struct("start", "order", "kind", "end"))))
    return each.withColumn("linked", linked).groupBy("row").agg(F.first("id").alias("id"), spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of :func:`scan`: n_assign, n_access, n_hex, n_weak, base_sha256, spans."""
    count = lambda *kinds: F.size(F.filter("spans", lambda s: s["kind"].isin(*kinds))).cast("long")
    base = F.filter("spans", lambda s: s["order"] < 3)
    return found.select(id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), count("weak_id", "weak_secret", "endpoint").alias("n_weak"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """``df`` with every reported span of its text replaced by ``mask``; all other columns stay.

    Rows and their matches are written first. Rows without a match are done then; only those with one, and of the others nothing,
    are shuffled, to judge their parts and to join the spans back by the row's number. Null texts stay null, empty ones and texts
    without spans stay as they are, repeated rows all stay. Overlapping spans become one mask. An empty table gives no rows.
    No name of a column is in the way."""
    packed = df.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("nth"), _all_matches(text_or_empty(text_col)).alias("matches"))
    noted = Scratch(df.sparkSession, "redact").keep(packed, "matches")
    matched = noted.filter(F.size("matches") > 0)
    found = _linked(matched.select(F.col("nth").alias("id"), F.col("nth").alias("row"), "matches"), scope).select(F.col("id").alias("nth"), "spans")
    out = matched.select("nth", "row", F.col("row")[text_col].cast("string").alias("text")).join(found, "nth")
    text = F.col("text")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))),
    )
    masked = F.when(F.size("spans") == 0, F.col("row")[text_col]).otherwise(cut)
    fields = [masked.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns]
    changed = out.select(F.struct(*fields).alias("out")).select("out.*")  # in a struct no name stands for another column
    return noted.filter(F.size("matches") == 0).select("row.*").union(changed)
