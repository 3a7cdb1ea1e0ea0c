"""Secret scans with an incremental blob ledger.

Every version of a file is content-addressed. A ledger holds one row per blob, rule and rule version that has been
scanned, with its findings. A scan reads only blobs with a pair that the ledger lacks, applies only the missing rules,
and findings are joined back to every path that has the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPAN = "struct<start:int,end:int>"
LEDGER = f"blob_id string, rule string, version int, spans array<{SPAN}>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters.

    Raising ``version`` makes every blob due again for this rule alone.
    """

    name: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 1),
    Rule("hosting", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 1),
)
RULES = BASE + ADDED


def blob_id(text: Column | str) -> Column:
    """Address of a content; a null text has the address of the empty one."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def due(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``rules``: the names of those whose current version the ledger lacks; blobs without any are left out."""
    current = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    done = (ledger.where(F.array_contains(current, F.struct("rule", "version")))
            .groupBy("blob_id").agg(F.collect_set("rule").alias("done")))
    names = F.array(*[F.lit(r.name) for r in rules])
    left = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "blob_id", "left").select(*blobs.columns, left.alias("rules")).where(F.size("rules") > 0)


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows for blobs with ``blob_id``, ``text`` and due ``rules``; a pair without findings has an empty list.

    Matches are leftmost and don't overlap; a failing match takes its text with it. Offsets count code points: what a split
    at the matches leaves between them and the matches themselves tile the text, so running lengths are the offsets.
    """
    matched = blobs.select("blob_id", "text", "rules", *[
        F.when(F.array_contains("rules", r.name), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).alias(f"m_{r.name}") for r in rules])
    parts = F.filter(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"m_{r.name}").alias("matches")) for r in rules]),
                     lambda p: F.size(p["matches"]) > 0)
    hits = matched.select("blob_id", "text", F.explode(parts).alias("p"))
    pieces = F.coalesce(*[F.when(F.col("p.rule") == r.name, F.split("text", r.pattern, -1)) for r in rules])
    value = F.coalesce(*[F.when(F.col("p.rule") == r.name, F.regexp_extract("z.matches", r.pattern, r.group) if r.group else F.col("z.matches")) for r in rules])
    least = F.coalesce(*[F.when(F.col("p.rule") == r.name, F.lit(r.least)) for r in rules])
    rows = (hits.select("blob_id", "p.rule", F.col("p.matches").alias("matches"), pieces.alias("pieces"), "p")
            .select("blob_id", "p", F.posexplode(F.arrays_zip("pieces", "matches")).alias("k", "z"))
            .where("z.matches is not null")
            .select("blob_id", F.col("p.rule").alias("rule"), "k", F.length("z.pieces").alias("gap"), F.length("z.matches").alias("n"),
                    (F.length(value) >= least).alias("holds")))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob_id", "rule").orderBy("k"))
    spans = (rows.withColumn("end", end.cast("int")).where("holds")
             .groupBy("blob_id", "rule").agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), "end"))).alias("spans")))
    version = F.coalesce(*[F.when(F.col("rule") == r.name, F.lit(r.version)) for r in rules])
    pairs = blobs.select("blob_id", F.explode("rules").alias("rule"))
    return (pairs.join(spans, ["blob_id", "rule"], "left")
            .select("blob_id", "rule", version.alias("version"), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans")))


def update(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows to append after a delivery of versions: each unseen content is scanned once, however often it occurs."""
    blobs = versions.select(blob_id(text).alias("blob_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return scan(due(blobs.dropDuplicates(["blob_id"]), ledger, rules), rules)


def by_path(versions: DataFrame, ledger: DataFrame, path: list[str], rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``path`` columns of every version with ``found``: rule order, start and end of each finding of the current rules.

    Each row of ``versions`` gives one row, repeated and null paths included; nothing found gives an empty list.
    """
    order = F.coalesce(*[F.when((F.col("rule") == r.name) & (F.col("version") == r.version), F.lit(k)) for k, r in enumerate(rules)])
    found = (ledger.where(F.size("spans") > 0).withColumn("kind", order).where("kind is not null")
             .select("blob_id", "kind", F.explode("spans").alias("s"))
             .groupBy("blob_id").agg(F.sort_array(F.collect_list(F.struct("s.start", "kind", "s.end"))).alias("found")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (versions.select(*path, blob_id(text).alias("blob_id")).join(found, "blob_id", "left")
            .select(*path, F.coalesce("found", none).alias("found")))


def joined(found: Column | str, rules: tuple[Rule, ...] = RULES, first: int | None = None) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined; ``first`` keeps the first so many kinds."""
    found = F.col(found) if isinstance(found, str) else found
    names = F.array(*[F.lit(r.name) for r in rules])
    if first is not None:
        found = F.filter(found, lambda f: f["kind"] < first)
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"].cast("string"), f["end"].cast("string"))), ",")
