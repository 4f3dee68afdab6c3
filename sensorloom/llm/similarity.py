"""Similarity join of documents by the Jaccard similarity of their word shingles, with chosen paths.

Documents with the same shingles are one set. In each run a set follows paths: at a node it is sent on by sampled
tokens, here positions of its MinHash sketch with their values, ``1 / similarity`` of them on average, so only sets
that share the token stay together. Small nodes are compared by brute force, those of more than a few sets in
blocks. A larger node whose sets all resemble one of them, its pivot, is done too; any other is split again, and what
is still large at the last level is compared in blocks, however large. Runs are repeated until a pair at the threshold is found with the target
probability even if its paths are split to the last level.

That finds candidates by their sketches, with a margin. Their connected families are then compared exactly, all
sets of a family with each other, in blocks of bounded size: only the number of links of each set and the links
that span a block are returned, never the pairs. The exact links decide the classes.

A family that forms one huge block of near copies costs its square in comparisons, spread over many tasks,
because the number of links is exact; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import apart
from sensorloom.llm.components import components
from sensorloom.llm.shingles import SHINGLE_BYTES, SHINGLE_WORDS, SKETCH, packed, set_identity, shingle_sets, sketch, unpacked
from sensorloom.session import released_copies, scratch_path, stored

SIMILARITY = 0.8
TARGET_RECALL = 0.999
LEVELS = 4
# Nodes that are compared by brute force: by neighbours in one sorted pass, and in blocks of sketches.
SMALL_NODE = 32
BLOCK_NODE = 4_096
SKETCH_BLOCK = 1_024
# Sets of a family that one task compares with as many others, and the bytes of their shingles; a family has blocks enough for both.
BLOCK = 256
BLOCK_BYTES = 32 << 20
# Standard deviations of a sketch's estimate by which candidates may fall below the similarity.
MARGIN = 4
# Groups of one block are dealt into batches of about so many bytes, many more than cores in small tables.
BATCH_BYTES = 8 << 20
ROW_BYTES = 64
LEAST_BATCHES = 4_096
# Shingles in one slice of the comparison of a block.
SLICE = 4096

SET_SCHEMA = "doc_id {key}, digest long, sid long, n_shingles int, sketch binary, shingles binary"


def runs_for(recall: float, similarity: float, levels: int) -> int:
    """Runs after which a pair at the similarity is found with the given probability, in the worst case.

    At every level a pair that is together has as many sampled positions as 1 / similarity has whole ones and, with
    the probability that is left, one more; it stays together in a child where the sketches agree.
    """
    always, chance = _samples(similarity)
    found = 1.0
    for _ in range(levels):
        found = 1 - (1 - similarity * found) ** always * (1 - chance * similarity * found)
    return 1 if found >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - found))


def candidate_share(similarity: float) -> float:
    """Share of equal sketch positions from which two sets are candidates for a similarity."""
    return similarity - MARGIN * math.sqrt(similarity * (1 - similarity) / SKETCH)


def _samples(similarity: float) -> tuple[int, float]:
    """Positions that every node samples, and the probability of one more."""
    always = math.floor(1 / similarity)
    return always, 1 / similarity - always


def _one_more(node: Column, similarity: float) -> Column:
    """Whether a node samples one more position."""
    return F.pmod(F.xxhash64(node, F.lit(2)), F.lit(1000)) < round(1000 * _samples(similarity)[1])


def _position(node: Column, which: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(which)), F.lit(SKETCH)).cast("int")


def _value(position: Column) -> Column:
    """Four bytes of the sketch."""
    return F.expr("sketch").substr(position * 4 + 1, F.lit(4))


def _children(node: Column, similarity: float) -> Column:
    def child(which: int) -> Column:
        place = _position(node, which)
        return F.xxhash64(node, place, _value(place))

    # The number 2 decides on one more position.
    always = [child(which) for which in (1, *range(3, 2 + _samples(similarity)[0]))]
    more = F.when(_one_more(node, similarity), child(2 + len(always)))
    return F.array_distinct(F.array_compact(F.array(*always, more)))


def shingle_table(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Documents as sets: identity of the set (NULL without words), its size, sketch and shingles."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), F.col(text).alias("_text")
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = list(shingle_sets(part.column("_text"), words))
                columns = {
                    "doc_id": part.column("doc_id"),
                    "digest": part.column("digest"),
                    "sid": pa.array([set_identity(s) for s in sets], pa.int64()),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int32()),
                    "sketch": pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    "shingles": pa.array([packed(s) for s in sets], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(hashed, SET_SCHEMA.format(key=kind))


def _agree(one: np.ndarray, other: np.ndarray, share: float) -> np.ndarray:
    return (one == other).mean(axis=-1) >= share


def _sketches(values: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint32).reshape(len(values), SKETCH)


def _stars(count: int, pairs: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Links from every linked row to the one with the smallest name that it is connected to, itself included."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(count, dtype=np.int64)
    rank[order] = np.arange(count)
    label = rank.copy()
    changed = len(pairs) > 0
    while changed:
        before = label.copy()
        np.minimum.at(label, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 1], label[pairs[:, 0]])
        changed = bool((label != before).any())
    linked = np.unique(pairs)
    return np.column_stack([linked, order[label[linked]]])


def _small_nodes(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """Candidate links that span the small nodes, from rows sorted by node."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        open_node = rows["node"] == rows["node"].iloc[-1]
        # The last node may go on in the next batch.
        rest = rows[open_node]
        yield _links_within(rows[~open_node], share)
    if rest is not None:
        yield _links_within(rest, share)


def _links_within(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    node, sid = rows["node"].to_numpy(), rows["sid"].to_numpy()
    values = _sketches(rows["sketch"])
    pairs = []
    for step in range(1, min(SMALL_NODE, len(rows))):
        first = np.flatnonzero(node[step:] == node[:-step])
        if not len(first):
            break
        first = first[_agree(values[first], values[first + step], share)]
        pairs.append(np.column_stack([first, first + step]))
    found = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
    found = _stars(len(rows), found, sid)
    return pd.DataFrame({"a": sid[found[:, 0]], "b": sid[found[:, 1]]})


def batches_of(small: DataFrame, bytes_of_row: Column) -> int:
    """Batches for the rows of groups of one block, so that one stays at a fixed size however many there are."""
    whole = small.agg(F.sum(bytes_of_row)).first()[0] or 0
    return max(LEAST_BATCHES, math.ceil(whole / BATCH_BYTES))


def family_blocks(sets: Column, whole: Column) -> Column:
    """Blocks for so many sets with so many bytes. Sets are dealt by hash, so blocks of bytes are planned half full."""
    return F.greatest(F.ceil(sets / BLOCK), F.least(F.ceil(2 * whole / BLOCK_BYTES) - 1, sets), F.lit(1)).cast("int")


def in_blocks(
    rows: DataFrame,
    group: str,
    size: str,
    block: int,
    work: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batches: int,
) -> DataFrame:
    """Apply work to the rows of a group, dealt into blocks by their ``sid`` and then taken two blocks at a time.

    Every pair of rows meets in the task of its two blocks; ``part`` tells which of the two a row is from. Groups
    of one block are dealt into batches: ``work`` gets rows of several groups.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("sid"), "_blocks").cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda other: F.struct(F.least("_own", other).alias("i"), F.greatest("_own", other).alias("j")),
    )
    dealt = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    dealt = dealt.withColumn("_pair", F.explode(pairs)).withColumn("part", (F.col("_own") != F.col("_pair.i")).cast("int"))
    single = F.col("_blocks") == 1
    # Groups of one block share tasks by hash; a pair of blocks has a task of its own.
    batch = F.when(single, F.pmod(F.xxhash64(group), F.lit(batches).cast("long"))).otherwise(F.xxhash64(group, "_pair.i", "_pair.j"))
    dealt = dealt.withColumns({"_batch": batch, "_many": ~single, "_same": F.col("_pair.i") == F.col("_pair.j")})
    columns = [*rows.columns, "part", "_batch", "_many", "_same"]
    return dealt.select(*columns).groupBy("_batch", "_many").applyInPandas(work, schema)


def _links_of_blocks(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """Candidate links that span each two blocks of a large node."""
    found = []
    for _, node in rows.groupby("node", sort=False):
        values, sid = _sketches(node["sketch"]), node["sid"].to_numpy()
        pairs = [np.empty((0, 2), np.int64)]
        for row in range(len(node) - 1):
            other = row + 1 + np.flatnonzero(_agree(values[row], values[row + 1 :], share))
            pairs.append(np.column_stack([np.full(len(other), row), other]))
        kept = _stars(len(node), np.concatenate(pairs), sid)
        found.append(pd.DataFrame({"a": sid[kept[:, 0]], "b": sid[kept[:, 1]]}))
    return pd.concat(found, ignore_index=True)


def _blocks_linked(share: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        return _links_of_blocks(rows, share)

    return links


def candidate_links(sets: DataFrame, similarity: float, recall: float, levels: int) -> DataFrame:
    """Links (a, b) that connect all sets whose sketches agree, from rows (sid, sketch).

    One job that counts, two a level and the writes between them; levels stop when no node is left to split.
    """
    runs, share = runs_for(recall, similarity, levels), candidate_share(similarity)
    roots = [F.lit(run).cast("long") for run in range(1, runs + 1)]
    paths = sets.select("sid", F.explode(F.flatten(F.array(*(_children(root, similarity) for root in roots)))).alias("node"))
    links, small, blocks = [], [], []
    for level in range(1, levels + 1):
        paths = stored(paths, f"paths-{level}")
        counts = paths.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor("sid").alias("_x"),
            F.bit_xor(F.xxhash64("sid", F.lit(level))).alias("_y"),
        )
        # Nodes with the same sets are one.
        nodes = counts.filter("n > 1").groupBy("n", "_x", "_y").agg(F.min("node").alias("node")).select("node", "n")
        rows = stored(paths.join(nodes, "node"), f"nodes-{level}")
        small.append(rows.filter(F.col("n") <= SMALL_NODE).select("node", "sid"))
        most = F.lit(True) if level == levels else F.col("n") <= BLOCK_NODE
        blocks.append(rows.filter((F.col("n") > SMALL_NODE) & most))
        large = rows.filter((F.col("n") > SMALL_NODE) & ~most)
        if large.isEmpty():
            break
        large = stored(large.join(sets, "sid"), f"large-{level}")
        # The smallest set leads, the same one in most nodes of a group, so that links of different nodes are equal.
        pivots = large.groupBy("node").agg(F.min(F.struct("sid", "sketch")).alias("_pivot"))
        pivots = pivots.select("node", F.col("_pivot.sid").alias("pivot"), F.col("_pivot.sketch").alias("_lead"))
        beside = large.join(pivots, "node")
        compared = stored(
            beside.withColumn("near", _resemble(F.col("sketch"), F.col("_lead"), share)).drop("_lead", "sketch"),
            f"pivots-{level}",
        )
        links.append(compared.filter("near AND pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b")))
        unlike = compared.groupBy("node").agg(F.min("near").alias("_done")).filter("NOT _done").select("node")
        left = large.join(unlike, "node", "left_semi")
        paths = left.select("sid", F.explode(_children(F.col("node"), similarity)).alias("node"))
    sorted_nodes = _all(small).join(sets, "sid").repartition("node").sortWithinPartitions("node")
    links.append(sorted_nodes.select("node", "sid", "sketch").mapInPandas(partial(_small_nodes, share=share), "a long, b long"))
    of_blocks = _all(blocks)
    batches = batches_of(of_blocks.filter(F.col("n") <= SKETCH_BLOCK), F.lit(4 * SKETCH + ROW_BYTES))
    of_blocks = of_blocks.join(sets, "sid")
    links.append(in_blocks(of_blocks, "node", "n", SKETCH_BLOCK, _blocks_linked(share), "a long, b long", batches))
    return _all(links)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _resemble(one: Column, other: Column, share: float) -> Column:
    """Whether enough positions of two sketches agree."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_agree(_sketches(a), _sketches(b), share) if len(a) else np.empty(0, bool))

    return near(one, other)


def _similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether sets are similar, all with each other."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(count), sizes)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    # A shingle of one set alone cannot be shared.
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((count, count), dtype=np.float32)
    for start in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(column, [start, start + SLICE])
        present = np.zeros((count, SLICE), dtype=np.float32)
        present[owner[lo:hi], column[lo:hi] - start] = 1
        common += present @ present.T
    either = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * either - 1e-6


def _exact_links(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def links(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of each set to sets of the other block (of its own once), and stars that span the blocks. A family
        of one block is settled by them."""
        found = []
        for _, family in rows.groupby("component", sort=False):
            sid = family["sid"].to_numpy()
            similar = _similar([unpacked(blob) for blob in family["shingles"]], threshold)
            part = family["part"].to_numpy()
            if family["_many"].iloc[0] and not family["_same"].iloc[0]:
                similar &= part[:, None] != part[None, :]
            np.fill_diagonal(similar, False)
            copies = family["copies"].to_numpy()
            counts = pd.DataFrame({"kind": "count", "a": sid, "b": sid, "links": similar @ copies, "texts": similar.sum(axis=1)})
            kept = _stars(len(sid), np.argwhere(np.triu(similar)), sid)
            settled = not family["_many"].iloc[0]
            spans = pd.DataFrame({"kind": "span", "a": sid[kept[:, 0]], "b": sid[kept[:, 1]], "links": 0, "texts": 0})
            found += [counts.assign(settled=settled), spans.assign(settled=settled)]
        return pd.concat(found, ignore_index=True)

    return links


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = SHINGLE_WORDS,
    recall: float = TARGET_RECALL,
    levels: int = LEVELS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: the key, ``digest`` (hash of the text), ``n_shingles``, ``class_id``, ``class_set``,
    ``n_links`` and ``n_similar``.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``similarity``; a text of fewer words is one shingle. A class is what links connect. ``class_set``, its smallest set,
    tells it from all others; ``class_id``, the smallest key in it, does not where keys are NULL or on several texts.
    ``n_links`` counts the other documents a document is linked with, exact copies included, ``n_similar`` the other
    sets. NULL, empty and blank texts have no shingles and no ``class_set``, are never linked and are classes of their own.
    Only the key and the text are read, so other columns cannot clash.

    Sets are named by 64 bits of their content. Runs at call: every step reads tables in the shared folder, of which only
    the result is left, since the shingles are larger than the documents.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity is above 0 and at most 1, not {similarity}")
    spark = docs.sparkSession
    path = scratch_path(spark, "classes")
    with released_copies(spark):
        classes = _classes(docs, similarity, words, recall, levels, key, text)
        classes.write.parquet(path)
    return spark.read.schema(classes.schema).parquet(path)


def _classes(
    docs: DataFrame, similarity: float, words: int, recall: float, levels: int, key: str, text: str
) -> DataFrame:
    table = stored(shingle_table(docs, key, text, words), "shingles")
    worded = table.filter("sid IS NOT NULL")
    members = table.select("doc_id", "digest", "sid", "n_shingles")
    # Copies of a set are counted before anything else, so their number does not matter later.
    sets = stored(
        worded.groupBy("sid").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.first("sketch").alias("sketch"),
            F.first("n_shingles").alias("n_shingles"),
        ),
        "sets",
    )
    candidates = components(candidate_links(sets.select("sid", "sketch"), similarity, recall, levels))
    candidates = stored(candidates.withColumnRenamed("node", "sid"), "families")
    weight = F.lit(SHINGLE_BYTES) * F.col("n_shingles").cast("long") + ROW_BYTES
    weighed = candidates.join(sets.select("sid", "copies", weight.alias("_bytes")), "sid")
    sizes = weighed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("_whole"))
    sizes = stored(sizes.withColumn("blocks", family_blocks(F.col("n"), F.col("_whole"))), "family-sizes")
    blobs = worded.join(candidates, "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))
    families = weighed.drop("_bytes").join(sizes.drop("_whole"), "component").join(blobs, "sid")
    exact = stored(
        in_blocks(
            families,
            "component",
            "blocks",
            1,
            _exact_links(similarity),
            "kind string, a long, b long, links long, texts long, settled boolean",
            batches_of(sizes.filter("blocks = 1"), F.col("_whole")),
        ),
        "exact-links",
    )
    spans = exact.filter("kind = 'span'")
    settled = spans.filter("settled").select(F.col("a").alias("sid"), F.col("b").alias("component"))
    # Only families of several blocks have links left to join up.
    loose = components(spans.filter("NOT settled").select("a", "b"))
    classes = settled.unionByName(loose.withColumnRenamed("node", "sid"))
    counts = exact.filter("kind = 'count'").groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = (
        sets.drop("sketch", "n_shingles")
        .join(classes, "sid", "left")
        .join(counts, "sid", "left")
        .withColumn("component", F.coalesce("component", "sid"))
    )
    names = known.groupBy("component").agg(F.min("first_id").alias("class_id"))
    known = known.join(names, "component").select(
        "sid",
        "class_id",
        F.col("component").alias("class_set"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_similar"),
    )
    linked = members.join(known, "sid", "left")
    return linked.select(
        F.col("doc_id").alias(key),
        "digest",
        "n_shingles",
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "class_set",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_similar", F.lit(0)).cast("long").alias("n_similar"),
    )


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, the one with the smallest key, with its own columns; of rows with the same key
    and text one stays. Documents without words all stay."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = apart(docs, id=F.col(key), digest=F.xxhash64(content), worded=content.rlike(r"[^\x20\x09-\x0D]"))
    classes = near_duplicates(docs, key=key, text=text, **options).filter("n_shingles > 0")
    # A class without a key in it has the NULL key as its name, and so may others; its set is its own.
    kept = (
        classes.filter(F.col(key).eqNullSafe(F.col("class_id")))
        .groupBy("class_set", "class_id")
        .agg(F.min("digest").alias("chosen"))
    )
    same = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("chosen"))
    chosen = rows.filter("worded").join(kept, same).dropDuplicates(["id", "digest"]).select("row.*")
    return chosen.unionByName(rows.filter("NOT worded").select("row.*"))


def similarity_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id", "class_set", "n_links", "n_similar", "n_shingles")
