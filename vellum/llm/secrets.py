"""Secret scans with linking of multipart credentials.

Patterns mark parts of credentials in whole texts: strong ones (assigned passwords and tokens,
access identifiers, long hex strings), which are always reported, and weak ones: other
identifiers, short assigned keys and endpoints, which mean little alone. A weak part is reported only
where complementary parts co-occur in its scope: a secret beside an identifier or endpoint, an identifier beside a secret,
an endpoint beside both. Two parts are in one scope if the intervals they cover are at most ``SCOPE`` code points apart, from the end of one
to the start of the other, however long they are. The interval join looks for the nearest partner of each class on either side, as running
extremes along the text: the greatest end among parts that start before, the least start among those after. It is linear in
the parts and makes no pairs; a weak part that is reported carries the partners found as its links.

A pattern's matches are split from the text between them; lengths of both, summed up
along the text, give positions in code points, in linear time. Only built-in functions are used.

Null and empty texts have no parts. Each row is scanned by itself: repeated rows repeat their result. An
empty table gives no rows. A long text is one row and is scanned whole; its parts are sorted in one task. Extra columns stay in ``redacted`` and are ignored
elsewhere, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import cut

#: Kinds of strong parts in their order, with pattern, group, and least length of that group.
STRONG = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # shorter runs would fail, and none holds a longer one
}
_TIE = r"[\"']?\x20{0,4}[:=]\x20{0,4}[\"']?"
#: Weak parts. A word boundary in front keeps them apart from longer words.
WEAK = {
    "identifier": (r"(?i)\b(access_?key(_?id)?|user(name)?|login|client_?id|account(_?id)?)" + _TIE + r"[A-Za-z0-9@._-]{3,}", 0, 5),
    "key": (r"(?i)\b(pass|pwd|passphrase|key|auth|credentials?|private_?key|signature)" + _TIE + r"[A-Za-z0-9+/_.=-]{6,}", 0, 8),
    "endpoint": (r"(?i)\b((https?|ftp|jdbc:[a-z]+|s3|postgres(ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|(host|endpoint|server|url)" + _TIE + r"[A-Za-z0-9._:/-]{4,})", 0, 6),
}
KINDS = {**STRONG, **WEAK}
SCOPE = 200
#: Texts without these have no part of the kind; they are cheaper to look for than the patterns.
WEAK_HINT = r"://|(?i:user|name|login|_?id|account|key|pass|phrase|pwd|auth|credentials?|signature|host|endpoint|server|url)[\"']?\x20{0,4}[:=]"
MASK = "[redacted]"
#: Classes of parts that complement each other.
CLASSES = {"secret": ("assign", "hex", "key"), "identifier": ("access", "identifier"), "place": ("endpoint",)}


def _parts(text: Column) -> Column:
    """array<struct<kind, rank, i, gap, size, ok>>: matches of all kinds, with the length of the text before each since the last."""
    none = F.array().cast("array<struct<kind:string,rank:int,i:int,gap:int,size:int,ok:boolean>>")
    tied = text.rlike("[:=]")
    weak = tied & text.rlike(WEAK_HINT)
    found = []
    for rank, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = lambda x: F.regexp_extract(x, pattern, group) if group else x  # noqa: E731, B023  a match matches itself whole
        zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), whole.alias("said"))
        rows = F.transform(F.filter(zipped, lambda x: x["said"].isNotNull()), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), i.alias("i"), x["gap"].alias("gap"), F.length(x["said"]).alias("size"), (F.length(value(x["said"])) >= least).alias("ok")))  # noqa: B023
        has = text.contains("AKIA") if kind == "access" else weak & text.rlike(pattern) if kind in WEAK else tied & text.rlike(pattern) if kind == "assign" else text.rlike(pattern)
        found.append(F.when(has, rows).otherwise(none))
    return F.concat(*found)


def reported(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, rank, start, end and links (array of said partners) of every reported part of ``rows`` (keys, the first of which numbers the rows, and parts); rows without any have one with null kind."""
    rows = rows.select(*keys, F.explode_outer("parts").alias("p")).select(*keys, "p.*").repartition(keys[0])
    along = Window.partitionBy(keys[0], "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("end") - F.col("size"))
    rows = rows.where(F.col("kind").isNull() | F.col("ok") | (F.col("i") == 0)).withColumn("kind", F.when(F.col("ok"), F.col("kind")))
    order = Window.partitionBy(keys[0]).orderBy("start", "rank", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    near: dict[str, tuple[Column, Column]] = {}
    for name, kinds in CLASSES.items():
        own = F.col("kind").isin(*kinds)
        left = F.max(F.when(own, F.struct("end", "start", "kind"))).over(before)
        right = F.min(F.when(own, F.struct("start", "end", "kind"))).over(after)
        near[name] = left, right
    rows = rows.withColumns({f"{side}_{name}": c for name, both in near.items() for side, c in zip(("left", "right"), both)})
    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    for name in CLASSES:
        left, right = F.col(f"left_{name}"), F.col(f"right_{name}")
        rows = rows.withColumn(name, F.array_compact(F.array(F.when(left["end"] >= F.col("start") - SCOPE, said(left)), F.when(right["start"] <= F.col("end") + SCOPE, said(right)))))
    has = lambda name: F.size(name) > 0
    linked = (
        F.when(F.col("kind") == "key", has("identifier") | has("place"))
        .when(F.col("kind") == "identifier", has("secret"))
        .when(F.col("kind") == "endpoint", has("secret") & has("identifier"))
        .otherwise(F.col("kind").isNotNull())
    )
    none = F.array().cast("array<string>")
    partners = F.when(F.col("kind") == "key", F.concat("identifier", "place")).when(F.col("kind") == "identifier", F.col("secret")).when(F.col("kind") == "endpoint", F.concat("secret", "identifier")).otherwise(none)
    return rows.withColumns({"kind": F.when(F.coalesce(linked, F.lit(False)), F.col("kind")), "links": partners}).select(*keys, "kind", "rank", "start", "end", "links")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and links (weak spans with their partners) of every document (doc_id, text)."""
    parts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _parts(F.coalesce(F.col("text"), F.lit(""))).alias("parts"))
    rows = reported(parts, ["row", "doc_id"])
    span = F.concat_ws(":", "kind", "start", "end")
    some = lambda which, said: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(which, F.struct("start", "rank", "end", said.alias("said"))))), lambda x: x["said"]), ",")
    strong = F.col("kind").isin(*STRONG)
    number = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    links = some(F.col("kind").isin(*WEAK), F.concat(span, F.lit(">"), F.array_join("links", "+"))).alias("links")
    return rows.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[number(k) for k in STRONG], F.sha2(some(strong, span), 256).alias("base_sha256"), some(F.col("kind").isNotNull(), span).alias("spans"), links).drop("row")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with reported spans masked in text, and n_chars following. Only texts that hold a part are shuffled."""
    scanned = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"), _parts(F.coalesce(F.col("text"), F.lit(""))).alias("parts")))
    held = scanned.where(F.size("parts") > 0)
    rows = reported(held.select("row", "parts"), ["row"]).where("kind is not null")
    order = Window.partitionBy("row").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("start") >= upto, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    spans = rows.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined, text = held.join(spans, "row"), F.col("doc.text")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.col("spans")[F.greatest(i - 1, F.lit(0))]["end"])
    kept = F.transform("spans", lambda x, i: F.concat(F.substr(text, (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(MASK)))
    masked = F.concat(F.array_join(kept, ""), F.substr(text, (F.element_at("spans", -1)["end"] + 1).cast("int"), F.length(text)))
    changed = joined.select(F.col("doc").withField("text", masked).alias("doc"))
    if "n_chars" in docs.columns:
        changed = changed.select(F.col("doc").withField("n_chars", F.length("doc.text").cast(docs.schema["n_chars"].dataType)).alias("doc"))
    unchanged = scanned.where(F.size("parts") == 0).unionByName(held.join(spans.select("row"), "row", "left_anti"))
    return unchanged.select("doc").unionByName(changed).select("doc.*")
