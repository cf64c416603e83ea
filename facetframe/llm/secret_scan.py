"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage

# The base kinds in their listed order, their patterns, the group that is the secret, and the
# least length of that group. Matches that are too short are found, and dropped afterwards.
KINDS = (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
         ("access", r"AKIA[A-Z0-9]+", 0, 20),
         ("hex", r"[0-9a-f]{24,}", 0, 24))
#: Candidates of the method's own: long runs with a digit, a small and a capital letter.
OWNED = ("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20)
#: A value held by more owners than this is a copied example.
MOST_OWNERS = 2

SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern with their positions in code points.

    Spark gives the matches and, by splitting, the gaps between them; positions are their running lengths.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(hits))
    steps = F.zip_with(gaps, F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("n"), v.alias("value"))),
                       lambda gap, x: F.struct(gap.alias("gap"), x["n"].alias("n"), x["value"].alias("value")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                        (start + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["n"]).alias("at"),
                        F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, zero, step)["out"]).otherwise(F.array().cast(SPANS))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """Per row: __at (row number of any order), doc_id, owner, base and owned spans. One pass over the texts."""
    rows = docs.select(col(id_col).alias("doc_id"), col(owner).cast("string").alias("owner"),
                       F.coalesce(col(text), F.lit("")).alias("t"))
    found = rows.withColumns({kind: _spans(F.col("t"), rank, kind, *rest)
                              for rank, (kind, *rest) in enumerate((*KINDS, OWNED))})
    base = F.array_sort(F.concat(*[F.col(k) for k, *_ in KINDS]))
    own = F.filter(F.col("owned"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]")
                   & s["value"].rlike("[A-Z]"))
    own = F.filter(own, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    hidden = [F.transform(F.col(c), lambda s: s.withField("value", F.sha2(s["value"], 256))).alias(c)
              for c in ("base", "owned")]
    return cut_lineage(found.withColumn("base", base).withColumn("owned", own).select(
        F.monotonically_increasing_id().alias("__at"), "doc_id", "owner", *hidden))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate (``value``, a SHA-256): distinct repositories (documents) and owners that hold it.

    A null owner counts as one owner, a null id as one repository of its owner.
    """
    held = found.select("doc_id", "owner", F.explode(F.array_distinct(F.transform(
        F.concat("base", "owned"), lambda s: s["value"]))).alias("value"))
    by_owner = held.groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("value", "owner").agg(
        F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"),
                                         F.count(F.lit(1)).alias("owners"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
                 most_owners: int = MOST_OWNERS) -> DataFrame:
    """Per row: doc_id, base spans, all spans (with ``live``), as arrays in order of start and kind.

    A span is live if at most ``most_owners`` owners hold its value, else a copied example. Candidates of the
    kind ``owned`` become spans only if they are live. Null and empty texts have no spans; repeated rows count
    as one repository and each keep their spans.
    """
    found = candidates(docs, id_col, text, owner)
    each = found.select("__at", F.explode(F.concat("base", "owned")).alias("s"))
    judged = each.join(ownership(found).withColumnRenamed("value", "__value"), F.col("s.value") == F.col("__value"))
    kept = judged.where((F.col("s.kind") != OWNED[0]) | (F.col("owners") <= most_owners))
    spans = kept.groupBy("__at").agg(F.array_sort(F.collect_list(F.struct(
        "s.start", "s.rank", "s.kind", "s.end", "s.value", "repositories", "owners",
        (F.col("owners") <= most_owners).alias("live")))).alias("__spans"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,repositories:bigint,"
                           "owners:bigint,live:boolean>>")
    return found.join(spans, "__at", "left").select("doc_id", "base", F.coalesce("__spans", empty).alias("spans"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    """The counts, digest and span list of each row of ``scan_secrets``."""
    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("base"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(_named(F.col("base")), 256).alias("base_sha256"),
                          _named(F.col("spans")).alias("spans"),
                          F.size(F.filter(F.col("spans"), lambda s: s["live"])).cast("long").alias("n_live"))
