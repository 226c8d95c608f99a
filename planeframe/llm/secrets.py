"""Secret scans with corpus-wide ownership frequency.

Patterns propose candidates in each text. Hashes of the candidates are then counted over the whole corpus by
distinct owners and repositories: what many owners or repositories hold is a widely copied example, what few hold and
looks random is a live-looking credential. Only hashes move; the counts are summed up before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from planeframe.llm import spans as S
from planeframe.llm.common import materialize, maybe_broadcast, narrow

KINDS = ["assign", "access", "hex", "provider"]

# Fixed by the contract (a run that is too short is no match either way).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
#: The method's own proposal: published shapes of providers' tokens; fixed values.
PROVIDER = (
    r"gh[pousr]_[A-Za-z0-9]{36,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
)
PROVIDER_HINTS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "sk_test_", "xox", "AIza", "eyJ", "PRIVATE KEY"]

#: Held by so many owners or repositories or more, a candidate is an example; a live-looking one has so many different characters.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, LIVE_CHARACTERS = 3, 10, 8
#: Finds of one value that meet one copy of its counts.
HOLDERS = 4096


def _any(text: Column, hints: list[str]) -> Column:
    out = text.contains(hints[0])
    for h in hints[1:]:
        out = out | text.contains(h)
    return out


def _random(value: Column) -> Column:
    return (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS) & value.rlike("[0-9]")


def find(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Secrets in `text` of docs(doc_id, text, <owner>, <repository>), one row for each row.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of the three base kinds' spans), spans (all spans),
    n_live, live (the spans that look live, listed likewise), owners and repositories (comma-joined, in the order
    of spans: how many owners and repositories hold that value). Spans are kind:start:end in code points, end exclusive, by start, then
    kind as in KINDS. A null text counts as empty; null ids stay null; all null owners count as one, and so do null repositories; repeated
    rows give repeated rows; other columns are ignored.
    """
    rows = narrow(docs, *dict.fromkeys(["doc_id", "text", owner, repository]))
    df = rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.xxhash64(F.col(owner).cast("string")).alias("owner"),
        F.xxhash64(F.col(repository).cast("string")).alias("repo"),
    )
    text = F.col("text")
    low = F.lower(text)
    df = df.select(
        "doc_id",
        "owner",
        "repo",
        S.matches(text, ASSIGN, 1, _any(low, ["passw", "secret", "token", "apikey", "api_key"])).alias("m0"),
        S.matches(text, ACCESS, where=text.contains("AKIA")).alias("m1"),
        S.matches(text, HEX, where=text.rlike("[0-9a-f]{16}")).alias("m2"),
        S.matches(text, PROVIDER, where=_any(text, PROVIDER_HINTS)).alias("m3"),
    )
    df = df.select(
        "doc_id",
        "owner",
        "repo",
        S.placed(F.col("m0"), 0, lambda x: F.length(x["value"]) >= 12).alias("s0"),
        S.placed(F.col("m1"), 1, lambda x: F.length(x["value"]) >= 18).alias("s1"),
        S.placed(F.col("m2"), 2, lambda x: F.lit(True)).alias("s2"),
        S.placed(F.col("m3"), 3, lambda x: F.lit(True)).alias("s3"),
    )
    df = df.select("*", S.ordered("s0", "s1", "s2", "s3").alias("every"))
    scanned = materialize(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "owner",
            "repo",
            S.number(F.col("s0")).alias("n_assign"),
            S.number(F.col("s1")).alias("n_access"),
            S.number(F.col("s2")).alias("n_hex"),
            F.sha2(S.listed(S.ordered("s0", "s1", "s2"), KINDS).cast("binary"), 256).alias("base_sha256"),
            S.listed(F.col("every"), KINDS).alias("spans"),
            F.transform("every", lambda s: F.struct(F.xxhash64(s["value"]).alias("hash"), _random(s["value"]).alias("random"))).alias("found"),
        ),
        "secrets",
    )
    held = scanned.select("row", "owner", "repo", F.posexplode("found").alias("at", "x")).select("row", "owner", "repo", "at", "x.*")
    owners, repositories = (held.select("hash", c).distinct().groupBy("hash").agg(F.count("*").alias(n)) for c, n in (("owner", "owners"), ("repo", "repositories")))
    many = held.groupBy("hash").agg(F.expr(f"(count(*) - 1) div {HOLDERS} + 1").alias("copies"))
    spread = materialize(owners.join(repositories, "hash").join(many, "hash"), "spread")
    # a value that is held very often is sent in copies, so that its holders meet it in many tasks
    hot = maybe_broadcast(spread.filter("copies > 1").select("hash", "copies"))
    dealt = held.join(hot, "hash", "left").withColumn("copy", F.expr("IF(copies IS NULL, 0L, pmod(row, copies))")).drop("copies")
    spread = spread.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    judged = (
        dealt.join(spread, ["hash", "copy"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("at", "owners", "repositories", (F.col("random") & (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES)).alias("live")))).alias("judged"))
    )
    out = scanned.join(judged, "row", "left")
    names = F.split("spans", ",")
    live = F.transform(F.filter("judged", lambda j: j["live"]), lambda j: F.get(names, j["at"]))
    return out.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        "spans",
        F.coalesce(F.size(live), F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce(F.array_join(live, ","), F.lit("")).alias("live"),
        *[F.coalesce(F.array_join(F.transform("judged", lambda j: j[n].cast("string")), ","), F.lit("")).alias(n) for n in ("owners", "repositories")],
    )
