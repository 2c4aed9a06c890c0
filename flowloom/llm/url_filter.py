"""Operator 7: URL filters as a sort-merge range join, in DataFrame functions only.

A rule (host, path) becomes the key ``reversed host / path``; what a rule fits is the interval of
keys that begin with it. The slash ends the host, which has none, so that a rule fits whole labels
only, with or without a path. A URL has one key for each suffix of its host's labels, with its path
behind, so a rule on a short host still fits a path under a longer one. Keys and the two ends of
every rule's interval are sorted together and swept: an interval's opening makes its rule the top
of the stack of active nested rules, its closing gives the top back to the enclosing rule, so the
last end seen before a key tells the longest rule that fits it.

Keys are dealt by their host and by their row: by host into as many groups as keep the rules' ends
below ``MAX_REPEATED`` when each group repeats its own for every one of its parts, and by row into at
least ``SALTS`` parts of a group. A host that has a third of all rows is swept by all parts of its group.

Defined results: a null URL or one without ``://`` has an empty host and path; an empty path fits no
rule that has one; of rules with the same host and path one that blocks wins; of rules equally long
on one URL the one with the longer host wins. A rule with a null host or path, or with ``/``, ``?``
or ``#`` in its host, fits nothing; the host of a rule may be empty and then fits an empty host, or
one that ends with a dot. Without a rule the verdict is ``default``. Repeated rows and null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Ends of intervals repeated over all parts, about.
MAX_REPEATED = 4_000_000
#: Parts at least that the keys of one host are dealt into by row.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(tail, r"\A[^?#]*", 0)


def canonical(host: Column) -> Column:
    """Labels of the host, the last first."""
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def interval_ends(rules: DataFrame) -> DataFrame:
    """``host, key binary, state``: a host's labels reversed, and the top of the stack from that key on
    (struct<rule, verdict, size, host_size>, null where no rule is active)."""
    clean = (
        rules.where(r"path is not null and not host rlike '[/?#]'")
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .select(
            canonical(F.col("host")).alias("host"), "path",
            F.struct(
                F.concat("host", "path").alias("rule"), "verdict",
                (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            ).alias("top"),
        )
    )
    # the enclosing rule has the longest proper prefix of the path that is a rule of the host: an
    # equi-join on prefixes, of those lengths only that rules of the host have
    lengths = clean.select("host", F.length("path").alias("n")).distinct()
    prefixes = clean.select("host", "path").join(lengths, "host").where("n < length(path)").select("host", "path", F.expr("substring(path, 1, n)").alias("outer"), "n")
    outer = (
        prefixes.join(clean.select("host", F.col("path").alias("outer"), F.col("top").alias("outer_top")), ["host", "outer"])
        .groupBy("host", "path").agg(F.max_by("outer_top", "n").alias("outer_top"))
    )
    binary = F.concat("host", F.lit("/"), "path").cast("binary")
    opened = clean.select("host", binary.alias("key"), F.struct(F.col("top").alias("now")).alias("state"))
    closed = clean.join(outer, ["host", "path"], "left").select(
        "host", F.concat(binary, F.unhex(F.lit("FF"))).alias("key"), F.struct(F.col("outer_top").alias("now")).alias("state")
    )
    return opened.unionByName(closed)


def default_rules(df: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in RULES])
    return df.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def filter_urls(
    pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None
) -> DataFrame:
    """``id, host, path, rule, verdict`` for every row of ``pages``."""
    rules = default_rules(pages) if rules is None else rules
    ends = interval_ends(rules)
    parts = parts or 4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(parts, max(SALTS, MAX_REPEATED // max(1, ends.count())))
    groups = -(-parts // salts)
    part_of = lambda name, salt: (F.pmod(F.xxhash64(name), F.lit(groups)) * salts + salt).cast("int")
    host, path = url_parts(F.col(url_col))
    labels = F.reverse(F.split("host", r"\.", -1))
    count = F.size(labels)
    rows = (
        pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("n", F.explode(F.sequence(F.lit(1), count)))
        .withColumn("name", F.array_join(F.slice(labels, F.lit(1), F.col("n")), "."))
    )
    keys = rows.select(
        part_of("name", F.pmod(F.xxhash64("row"), F.lit(salts))).alias("part"), F.concat("name", F.lit("/"), "path").cast("binary").alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(ends.schema["state"].dataType).alias("state"), "row", F.when(F.col("n") == 1, F.struct("id", "host", "path")).alias("page"),
    )
    repeated = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        part_of("host", F.col("salt")).alias("part"), "key", F.lit(0).alias("kind"), "state", F.lit(None).cast("long").alias("row"),
        F.lit(None).cast(keys.schema["page"].dataType).alias("page"),
    )
    sweep = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = keys.unionByName(repeated).withColumn("top", F.last("state", ignorenulls=True).over(sweep)["now"]).where("kind = 1")
    best = F.max(F.when(F.col("top").isNotNull(), F.struct(F.col("top.size").alias("size"), F.col("top.host_size").alias("host_size"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))))
    # in one group all keys of a row are in its part, so this makes no other exchange
    by = ["part", "row"] if groups == 1 else ["row"]
    return swept.groupBy(*by).agg(F.max("page").alias("page"), best.alias("best")).select(
        F.col("page.id").alias(id_col), F.col("page.host").alias("host"), F.col("page.path").alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE_SQL = """
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut as (select page_id, case when coalesce(instr(url, '://'), 0) > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from cut),
urls as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from parts),
fits as (select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h) + length(p) desc, length(h) desc) as k
         from urls join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') as verdict from urls u left join fits f on u.page_id = f.page_id and f.k = 1
"""
