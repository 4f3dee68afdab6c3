"""Secrets in texts, judged by who owns them across the corpus.

Candidates are found by patterns of known shapes and, beside them, as long tokens that look random. Every candidate is
hashed, and the hashes are counted over the whole corpus by distinct repositories and distinct owners. What many
owners have is an example that was copied, and so is what many repositories have if a number is given for them; the
rest is its owners' credential. Known shapes are always reported, with that judgement; a long token only if it is owned.

Offsets count code points. A pattern splits a text into the parts between its matches, whose running lengths give the
offsets; only the matches leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.session import stored

# Fixed values of the known shapes: pattern, group that holds the secret, least length of that group.
NAMES = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, NAMES)) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs of these classes are maximal, so a least length inside the pattern drops the same matches as one after it.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
BASE = ("assign", "access", "hex")
OWNED = "owned"
SHAPES = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24), OWNED: (TOKEN, 0, 20)}

# An example is held by at least so many owners; a long token has so many different characters.
EXAMPLE_OWNERS = 3
# Repositories from which on copies make an example, whoever owns them.
EXAMPLE_REPOSITORIES = 20
TOKEN_CHARACTERS = 10
# Cells over which the occurrences of one hash are dealt when they meet its counts.
CELLS = 64


def _matches(text: Column, kind: str) -> Column:
    """All matches of a kind as structs; NULL where there is none."""
    expression, group, least = SHAPES[kind]
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(expression), F.lit(group))
    between = F.split(text, expression, -1)
    zipped = F.arrays_zip(found.alias("found"), values.alias("value"), F.slice(between, 1, F.size(found)).alias("before"))
    rows = F.transform(
        zipped,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("nth"),
            F.length(m.getField("before")).alias("gap"),
            F.length(m.getField("found")).alias("width"),
            F.length(m.getField("value")).alias("long"),
            m.getField("value").alias("value"),
        ),
    )
    return F.when(text.rlike(expression), rows)


def looks_random(value: Column) -> Column:
    """Whether a token mixes digits, lower and upper case and has many different characters."""
    mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
    return mixed & (F.size(F.array_distinct(F.split(value, ""))) >= TOKEN_CHARACTERS)


def candidates(docs: DataFrame, key: str, text: str, repository: str, owner: str) -> DataFrame:
    """One row per match: ``_id``, ``_digest``, ``kind``, ``start``, ``end``, ``hash`` of the secret, ``_repository``, ``_owner`` and
    ``random``. Long tokens inside another match are left out."""
    rows = docs.select(
        F.col(key).alias("_id"),
        F.coalesce(text, F.lit("")).alias("_text"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("_repository"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"),
    )
    kinds = [F.coalesce(_matches(F.col("_text"), kind), _no_match()) for kind in SHAPES]
    found = rows.select(
        "_id",
        F.xxhash64("_text").alias("_digest"),
        "_repository",
        "_owner",
        F.monotonically_increasing_id().alias("_row"),
        F.concat(*kinds).alias("_matches"),
    ).filter(F.size("_matches") > 0)
    flat = found.select("_id", "_digest", "_repository", "_owner", "_row", F.explode("_matches").alias("_match"))
    flat = flat.select("_id", "_digest", "_repository", "_owner", "_row", "_match.*").repartition("_row")
    so_far = Window.partitionBy("_row", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = flat.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(so_far).cast("int"))
    placed = ends.withColumn("start", F.col("end") - F.col("width"))
    least = F.element_at(F.create_map(*(x for kind, (_, _, n) in SHAPES.items() for x in (F.lit(kind), F.lit(n)))), F.col("kind"))
    earlier = Window.partitionBy("_row").orderBy("start", F.col("end").desc(), "kind")
    known = F.col("kind") != OWNED
    inside = F.max(F.when(known, F.col("end"))).over(earlier.rowsBetween(Window.unboundedPreceding, 0)) >= F.col("end")
    return (
        placed.filter(F.col("long") >= least)
        .withColumn("_inside", inside)
        .filter(known | ~F.coalesce("_inside", F.lit(False)))
        .withColumn("random", looks_random(F.col("value")))
        .filter(known | F.col("random"))
        .select("_id", "_digest", "_repository", "_owner", "kind", "start", "end", F.sha2("value", 256).alias("hash"), "random")
    )


def _no_match() -> Column:
    return F.array().cast("array<struct<kind:string,nth:int,gap:int,width:int,long:int,value:string>>")


def owned_counts(found: DataFrame) -> DataFrame:
    """Distinct repositories and owners of each hash, beside every candidate as ``n_repositories`` and ``n_owners``.

    Distinct counts shuffle by (hash, value) first, so a hash that a third of the rows hold is counted by many tasks. On
    the way back its occurrences are dealt into cells, each of which gets the counts once.
    """
    counts = found.groupBy("hash").agg(
        F.countDistinct("_repository").alias("n_repositories"), F.countDistinct("_owner").alias("n_owners")
    )
    dealt = found.withColumn("_cell", F.pmod(F.xxhash64("_repository", "_id", "_digest", "start"), F.lit(CELLS)))
    cells = dealt.select("hash", "_cell").distinct().join(counts, "hash")
    return dealt.join(cells, ["hash", "_cell"]).drop("_cell")


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: str = "doc_id",
    owner: str = "source",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int | None = None,
) -> DataFrame:
    """One row per document: the key and ``secrets``, sorted structs (start, order, end, kind, n_repositories, n_owners,
    live).

    ``live`` tells that fewer than ``example_owners`` owners hold the secret and, if it is given, fewer than
    ``example_repositories`` repositories, so that many copies make it an example even where one owner has them all. NULL texts are empty; NULL repositories and owners
    count as one of their own; rows with the same key and text get the same result. One job at call, which stores the
    candidates.
    """
    found = stored(candidates(docs, key, text, repository, owner), "secrets")
    live = F.col("n_owners") < example_owners
    if example_repositories is not None:
        live &= F.col("n_repositories") < example_repositories
    judged = owned_counts(found).withColumn("live", live)
    judged = judged.filter((F.col("kind") != OWNED) | F.col("live"))
    order = F.array_position(F.array(*map(F.lit, SHAPES)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "end", "kind", "n_repositories", "n_owners", "live")
    spans = judged.groupBy("_id", "_digest").agg(F.sort_array(F.collect_set(span)).alias("secrets"))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_digest"))
    none = F.array().cast(spans.schema["secrets"].dataType)
    return rows.join(spans, same, "left").select(F.col("_key").alias(key), F.coalesce("secrets", none).alias("secrets"))


def _shown(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string")),
        ),
        ",",
    )


def secrets_digest(docs: DataFrame) -> DataFrame:
    """Base spans, all spans and the number of live ones per document, judged by owners and by repositories."""
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s.getField("kind") != OWNED)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s.getField("kind") == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs, example_repositories=EXAMPLE_REPOSITORIES).select(
        "doc_id",
        *(count(kind) for kind in BASE),
        F.sha2(_shown(base), 256).alias("base_sha256"),
        _shown(spans).alias("spans"),
        F.size(F.filter(spans, lambda s: s.getField("live"))).cast("long").alias("n_live"),
    )
