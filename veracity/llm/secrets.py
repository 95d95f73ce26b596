"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. Blobs that the ledger has no entry for
under the current version of a rule are scanned once, however many paths hold them; the ledger then gets one
row per scanned blob and rule with its spans, and findings are joined back to all paths by address.

A rule has a kind, a version, a pattern and a test of each match. Matches are leftmost and do not overlap; the
pieces between matches (`split`) and the matches (`regexp_extract_all`) give their places in code points. The
test drops matches, not text, so a dropped match still uses up its characters.

Cases: a null text is empty and has no finding; texts of any length are scanned whole; equal texts share one
scan, also when a third of all rows are one text (a path is one narrow row in the join back, which skewed-join
handling splits); null ids pass through; empty tables give empty results; a column that clashes with a result
column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.checkpoints import materialize


@dataclass(frozen=True)
class Rule:
    """`least` characters are needed in `group` of the match."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),  # shorter runs fail whole, so the length stands in the pattern
)
SPAN = "array<struct<start:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Start and exclusive end, in code points, of each match that passes."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.transform(found, lambda m: F.length(m if not rule.group else F.regexp_extract(m, f"^{rule.pattern}", rule.group)) >= rule.least)
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(found, F.length).alias("size"), kept.alias("ok"))
    rows = F.slice(rows, 1, F.size(found))  # the last gap has no match behind it
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["size"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(rows, state, step, lambda acc: acc["spans"])
    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), spans).otherwise(F.array().cast(SPAN))


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds `blob`, the content address of each row's text."""
    return versions.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))


def scan(versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Ledger rows (blob, kind, version, spans) of the blobs in `versions` that `ledger` lacks, one per blob and rule.

    Equal texts meet by address: each partition first keeps one row per address, so a common text crosses the
    shuffle once per partition.
    """
    blobs = addressed(versions.select(text), text).groupBy("blob").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    if ledger is not None:
        current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        seen = ledger.select("blob", F.struct("kind", "version").alias("rule")).where(F.array_contains(current, F.col("rule")))
        seen = seen.groupBy("blob").agg(F.collect_set("rule.kind").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        skip = F.coalesce(F.col("seen"), F.array().cast("array<string>"))
    else:
        skip = F.array().cast("array<string>")
    entries = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.array_contains(skip, r.kind).alias("old"), F.when(~F.array_contains(skip, r.kind), spans_of(F.col("text"), r)).alias("spans")) for r in rules]
    return blobs.select("blob", F.explode(F.array(*entries)).alias("e")).where("not e.old").select("blob", "e.kind", "e.version", "e.spans")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Each row of `versions` without its text, with `spans`: its blob's findings by start, then in the rules' order."""
    rank = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(i)) for i, r in enumerate(rules)])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    found = ledger.where(current & (F.size("spans") > 0)).select("blob", rank.alias("rank"), "kind", F.explode("spans").alias("s"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("s.start", "rank", "kind", "s.end"))).alias("spans"))
    paths = addressed(versions.drop("blob", "spans") if text not in ("blob", "spans") else versions, text).drop(text)
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def scan_incremental(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings for all rows and the ledger rows to append; only blobs and rule versions unseen by `ledger` are scanned."""
    new = materialize(scan(versions, rules, ledger, text), "ledger")
    whole = new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
    return findings(versions, whole, rules, text), new


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    found, _ = scan_incremental(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]", ledger: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` with every found span replaced by `mark`; n_chars, if there, is counted anew where a text changed.

    Spans come from the ledger, so equal texts are scanned once, and with a ledger only unseen ones; they are joined
    back by content address.
    """
    kept = docs.columns
    row = addressed(docs.select(F.struct(*kept).alias("doc"), F.col("text")))
    _, new = scan_incremental(docs.select("text"), ledger)
    whole = new if ledger is None else ledger.select("blob", "kind", "version", "spans").unionByName(new)
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in RULES])
    found = whole.where(F.array_contains(current, F.struct("kind", "version")) & (F.size("spans") > 0))
    found = found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    out = row.join(found, "blob", "left")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", state, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = out.withColumn("new", F.when(F.col("spans").isNotNull(), clean).otherwise(F.col("text")))
    values = {c: F.col(f"doc.`{c}`") for c in kept} | {"text": F.col("new")}
    if "n_chars" in kept:
        values["n_chars"] = F.when(F.col("spans").isNotNull(), F.length("new")).otherwise(values["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in values.items()])
