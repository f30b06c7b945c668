"""Secret scans judged by how many owners and repositories share each candidate.

A scan finds candidates by pattern.  A pattern cannot tell a live credential
from a sample that everybody copied out of the same manual, so each candidate's
hash is counted over the whole corpus: by distinct repositories and by distinct
owners.  Held by few owners in few repositories and looking alive, it is a
credential; held by many of either, an example.  Copies of one whole text say
nothing of a value in it, so repositories count no further than distinct texts.

Everything is DataFrame work: offsets come from splitting a text at its matches
and adding up the lengths of the pieces, counts from two-step distinct
aggregates (hash and owner first, so that a widely copied value is spread over
its owners), and the verdict from an equi-join on the hash that AQE may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import materialize


@dataclass(frozen=True)
class Kind:
    """A pattern (Java syntax), the group that holds the value, and the value's least length.

    A ``block`` is a value of several lines: it is hashed and judged without its
    white space and escaped line ends, and only its head may make it a placeholder.
    """

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True
    block: bool = False


# The patterns, in the order in which kinds are listed.  A run of one class of characters that is too short is
# no match of ``{n,}`` wherever it is entered, so access and hex leave them out at once and not by ``least``.  The header of a
# private key is the same for everybody, so its value is the body, which ends at the first five dashes; loops are possessive, so
# that a header without its END line costs no more than the text up to there.
KINDS = (
    Kind("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
    Kind("vendor", r"\b(?:gh[pousr]_|glpat-|sk_live_|xox[abpr]-|AIza)[A-Za-z0-9_-]{16,}", base=False),
    Kind("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
    Kind("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([^-]*+(?:-{1,4}+[^-]++)*+)-----END [A-Z ]{0,40}PRIVATE KEY-----", 1, 40, base=False, block=True),
    Kind("opaque", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[A-Z0-9_-]*+[a-z])(?=[a-z0-9_-]*+[A-Z])[A-Za-z0-9_-]{24,}+", base=False),
)
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your|xxxx|0000|1234"
#: So much of a block is searched for placeholders: one of them stands somewhere in a few of a thousand real keys by chance.
HEAD = 64


def looks_live(value: Column, head: int | None = None) -> Column:
    """Long and varied enough for a real credential, and not a placeholder (looked for in the first ``head`` characters)."""
    variety = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= 8) & (variety >= 6) & value.rlike("[0-9]") & ~(value if head is None else F.substring(value, 1, head)).rlike(PLACEHOLDER)


def _pieces(text: Column, kind: Kind, number: int) -> Column:
    """An entry for each match: the text before it, its own length, and what is kept of its value."""
    zipped = F.arrays_zip(
        F.split(text, kind.pattern, -1).alias("before"),
        F.regexp_extract_all(text, F.lit(kind.pattern), 0).alias("hit"),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)).alias("value"),
    )
    value = lambda z: F.regexp_replace(z["value"], r"\s|\\[nr]", "") if kind.block else z["value"]
    # the last piece stands behind the last match
    return F.transform(
        F.filter(zipped, lambda z: z["hit"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("i"),
            F.length(z["before"]).cast("long").alias("before"),
            F.length(z["hit"]).cast("long").alias("size"),
            (F.length(value(z)) >= kind.least).alias("ok"),
            looks_live(value(z), HEAD if kind.block else None).alias("live"),
            F.sha2(value(z), 256).alias("hash"),
        ),
    )


def candidates(docs: DataFrame, *, text: str, owner: str, repo: str, keep: list[str], kinds=KINDS) -> DataFrame:
    """One row per row of ``docs``: a row number, ``keep``, owner, repository and the pieces of all matches.

    It is written to the shared folder: every later step needs it, it holds
    hashes in place of secrets, and the texts are read once.
    """
    # patterns see the whole text; a null text is an empty one
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        *[F.col(c).alias(f"keep_{c}") for c in keep],
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"),
        t.alias("text"),
    )
    found = base.select(
        F.monotonically_increasing_id().alias("rid"),
        *[f"keep_{c}" for c in keep],
        "owner",
        "repo",
        F.xxhash64("text").alias("digest"),
        F.concat(*[_pieces(F.col("text"), k, n) for n, k in enumerate(kinds)]).alias("pieces"),
    )
    return materialize(found, "secret-candidates")


def locate(found: DataFrame) -> DataFrame:
    """Spans of all candidates: each match starts where the lengths before it add up to."""
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = found.filter(F.size("pieces") > 0).select("rid", "owner", "repo", "digest", F.inline("pieces"))
    rows = rows.withColumn("end", F.sum(F.col("before") + F.col("size")).over(w))
    return rows.filter("ok").select("rid", "owner", "repo", "digest", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "live", "hash")


def ownership(spans: DataFrame) -> DataFrame:
    """Distinct owners, repositories and whole texts of every candidate hash."""
    pairs = spans.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    counts = owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places"))
    texts = spans.groupBy("hash", "digest").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_texts"))
    return counts.join(texts, "hash")


def judge(spans: DataFrame, *, most_owners: int, most_repos: int) -> DataFrame:
    """Spans with their hash's counts and a verdict: ``live``, ``example`` (too many owners or repositories) or ``weak``."""
    many = (F.col("n_owners") > most_owners) | (F.least("n_repos", "n_texts") > most_repos)
    verdict = F.when(many, "example").when(F.col("live"), "live").otherwise("weak")
    return spans.join(ownership(spans), "hash").withColumn("verdict", verdict)


def scan(docs: DataFrame, *, text: str = "text", owner: str = "source", repo: str = "doc_id", keep: list[str], most_owners: int = 2, most_repos: int = 8, kinds=KINDS) -> DataFrame:
    """One row per row of ``docs``: ``keep`` and ``found``, its spans in order of start and kind.

    ``found`` holds (start, kind number, kind, end, verdict, n_owners, n_repos),
    in code points, end exclusive.  Base kinds are always there; the others only
    where the verdict is ``live``.

    Edge cases: a null or empty text has no spans; repeated rows are scanned
    each for itself and count as one repository; a null owner or repository
    counts as one of its own; an empty table gives an empty result; only the
    named columns are read, so others may have any name.
    """
    found = candidates(docs, text=text, owner=owner, repo=repo, keep=keep, kinds=kinds)
    names = F.array(*[F.lit(k.name) for k in kinds])
    base = [n for n, k in enumerate(kinds) if k.base]
    judged = judge(locate(found), most_owners=most_owners, most_repos=most_repos).filter(F.col("kind").isin(base) | (F.col("verdict") == "live"))
    entry = F.struct("start", "kind", F.element_at(names, F.col("kind") + 1).alias("name"), "end", "verdict", "n_owners", "n_repos")
    lists = judged.groupBy("rid").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    rows = found.select("rid", *[f"keep_{c}" for c in keep]).join(lists, "rid", "left")
    none = F.array().cast(lists.schema["found"].dataType)
    return rows.select(*[F.col(f"keep_{c}").alias(c) for c in keep], F.coalesce("found", none).alias("found"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(scanned: DataFrame, *, keep: list[str], kinds=KINDS) -> DataFrame:
    """Counts per base kind, the base digest and all spans as one string."""
    base = F.filter("found", lambda s: s["name"].isin([k.name for k in kinds if k.base]))
    count = lambda k: F.size(F.filter("found", lambda s: s["name"] == k.name)).cast("long")
    with_verdict = lambda v: F.size(F.filter("found", lambda s: s["verdict"] == v)).cast("long")
    return scanned.select(
        *keep,
        *[count(k).alias(f"n_{k.name}") for k in kinds if k.base],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        with_verdict("live").alias("n_live"),
        with_verdict("example").alias("n_example"),
    )


def redact(docs: DataFrame, *, text: str = "text", owner: str = "source", repo: str = "doc_id", most_owners: int = 2, most_repos: int = 8, mark: str = "<secret>", kinds=KINDS) -> DataFrame:
    """``docs`` with every live span of ``text`` replaced by ``mark``; examples, weak finds and all rows stay.

    Overlapping spans are replaced as one.  The texts travel with their row, so
    no join brings them back.

    Edge cases: a null text stays null, an empty one empty; a null owner or
    repository counts as one of its own; repeated rows are replaced alike; an
    empty table gives an empty result; columns of any name but
    ``<text>__secret_key`` and ``<text>__secret_key_spans`` pass unchanged.
    """
    t, n = F.coalesce(F.col(text), F.lit("")), f"{text}__secret_key"
    keyed = docs.withColumn(n, F.xxhash64(F.col(repo).cast("string"), t))
    found = candidates(keyed, text=text, owner=owner, repo=repo, keep=[n], kinds=kinds)
    live = judge(locate(found), most_owners=most_owners, most_repos=most_repos).filter("verdict = 'live'")
    # repeated rows have the same spans: one list per distinct (repository, text)
    lists = live.join(found.select("rid", f"keep_{n}"), "rid").groupBy(F.col(f"keep_{n}").alias(n)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(f"{n}_spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        F.col(f"{n}_spans"),
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(t, (a["at"] + 1).cast("int"), F.length(t))),
    )
    out = keyed.join(materialize(lists, "secret-spans"), n, "left")
    return out.select(*[F.when(F.col(f"{n}_spans").isNull(), F.col(c)).otherwise(cut).alias(c) if c == text else F.col(c) for c in docs.columns])
