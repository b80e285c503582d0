"""Near copies of whole texts (the near-duplicate stage of the pipeline): SimHash proposes, sets decide.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more.
Texts with the same words are one class from the start. A class gets a long SimHash fingerprint of
``tables`` bands and a sketch. Each band in turn is put in front, as the root of an index: a cell. Inside
a cell the sketches are sorted by Gray rank, and the hierarchical index of ``simhash`` finds those that
are near: groups whose shared bits differ in too many places are left out whole. That is a loose net: at
similarity 0.8 a bit agrees with probability 0.85, so that one of 64 bands of 20 bits agrees with
probability 0.91, and more often above. Inside each connected blob of the net the shingle sets
themselves are compared, and only pairs at or above the similarity link.

Each task gives a spanning forest of the links it finds, so that no group is listed in pairs. A cell
or a blob that is too large for one task is dealt into parts that meet two at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm import local_links, simhash
from trailmark.llm.components import connected_components
from trailmark.llm.workers import map_batches, slices, stored

SIMILARITY, SHINGLE, SEED = 0.8, 5, 42
BAND_BITS, TABLES = 20, 64
#: Words of 64 bits of the sketch, and the most bits in which linked sketches differ.
SKETCH_WORDS, SKETCH_BITS = 2, 32
#: Classes of a cell, and texts and bytes of a part of a blob, that one task compares with each other.
CELL_LIMIT, PART_TEXTS, PART_BYTES = 2_048, 512, 16_000_000
#: Shingles whose bits are counted at a time.
CHUNK = 4_096


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count


def class_of(words: list[bytes]) -> str:
    """One name for all texts with the same words."""
    return xxhash.xxh3_128_hexdigest(b" ".join(words))


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The different hashes of runs of ``shingle`` words; a shorter text is one run, none without words."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    hash64 = xxhash.xxh3_64_intdigest
    return np.unique(np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (of 64-bit words) have each bit set: sums and carries, three rows at a time."""
    counts = np.zeros(rows.shape[1] * 64, dtype=np.int64)
    terms, weight = rows, 0
    while len(terms):
        carried = []
        while len(terms) > 2:
            third, rest = divmod(len(terms), 3)
            x, y, z = terms[:third], terms[third : 2 * third], terms[2 * third : 3 * third]
            differ = x ^ y
            carried.append((x & y) | (differ & z))
            terms = np.concatenate([differ ^ z, terms[3 * third :]]) if rest else differ ^ z
        digit = terms[0]
        if len(terms) == 2:
            carried.append(terms[:1] & terms[1:])
            digit = terms[0] ^ terms[1]
        counts += np.unpackbits(digit.view(np.uint8), bitorder="little").astype(np.int64) << weight
        terms = np.concatenate(carried) if carried else terms[:0]
        weight += 1
    return counts


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` * 64 bits: each is set if more than half of the hashes, mixed anew for each word, have it."""
    counts = np.zeros(words * 64, dtype=np.int64)
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[at : at + CHUNK, None] + steps
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += bit_counts(mixed ^ (mixed >> np.uint64(31)))
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def _printer(shingle: int, band_words: int):
    def run(batches):
        for part in slices(batches):
            words = [words_of(text) for text in part.column("text").to_pylist()]
            prints = np.array(
                [wide_fingerprint(shingle_set(w, shingle), band_words + SKETCH_WORDS) for w in words],
                dtype=np.uint64,
            ).reshape(len(words), -1)
            sketches = prints[:, band_words:].copy().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([class_of(w) for w in words], pa.string()),
                    pa.array([row.tobytes() for row in prints[:, :band_words]], pa.binary()),
                    *[pa.array(sketches[:, i]) for i in range(SKETCH_WORDS)],
                ],
                ["doc_id", "class", "bands", "s0", "s1"],
            )

    return run


def _cells(classes: DataFrame, band_bits: int, tables: int) -> DataFrame:
    """A row per class and table: the cell (table and band), node, sketch."""

    def run(batches):
        powers = 1 << np.arange(band_bits, dtype=np.int64)
        for part in slices(batches):
            flat = np.frombuffer(b"".join(part.column("bands").to_pylist()), dtype=np.uint8)
            bits = np.unpackbits(flat, bitorder="little").reshape(part.num_rows, -1)[:, : tables * band_bits]
            values = bits.reshape(part.num_rows, tables, band_bits).astype(np.int64) @ powers
            cells = values + (np.arange(tables, dtype=np.int64) << band_bits)
            repeated = [
                pa.array(np.repeat(part.column(name).to_numpy(), tables)) for name in ("node", "s0", "s1")
            ]
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), *repeated], ["cell", "node", "s0", "s1"])

    narrow = classes.select("node", "bands", "s0", "s1")
    return map_batches(narrow, run, "cell bigint, node bigint, s0 bigint, s1 bigint")


def _dealt(rows: DataFrame, key: str, parts: Column, spread: Column) -> DataFrame:
    """Rows with ``deal`` and ``side``: each pair of the parts of a key meets in one deal."""
    own = F.pmod(F.xxhash64(spread), F.col("parts"))
    dealt = rows.withColumn("parts", parts.cast("bigint")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") == low, 1).otherwise(2)
    return (
        dealt.withColumn("deal", low * F.col("parts") + high)
        .withColumn("side", side)
        .drop("parts", "own", "other")
    )


def _sketch_links(batches):
    """node pairs: a spanning forest of near sketches in each cell.

    Rows come sorted by cell, deal and the Gray rank of the sketch.
    """
    held: list[pa.RecordBatch] = []

    def linked(table: pa.Table) -> pa.RecordBatch:
        cell, deal, node, side, s0, s1 = (
            table.column(name).to_numpy() for name in ("cell", "deal", "node", "side", "s0", "s1")
        )
        group = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (deal[1:] != deal[:-1])]))
        labels = np.arange(len(cell))
        met = np.flatnonzero(np.bincount(group)[group] > 1)  # most cells have one row
        sketches = np.stack([s0[met], s1[met]]).view(np.uint64)
        for i, j in simhash.close_pairs(sketches, SKETCH_BITS, group[met]):
            i, j = met[i], met[j]
            meets = (side[i] == 0) | (side[i] != side[j])
            labels = local_links.merge(labels, i[meets], j[meets])
        moved = np.flatnonzero(labels != np.arange(len(cell)))
        ends = [pa.array(node[x]) for x in (moved, labels[moved])]
        return pa.RecordBatch.from_arrays(ends, ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, deal = batch.column("cell").to_numpy(), batch.column("deal").to_numpy()
        # The last cell may go on in the next batch.
        open_from = int(np.flatnonzero((cell != cell[-1]) | (deal != deal[-1]))[-1:].sum() + 1)
        if (cell[0], deal[0]) == (cell[-1], deal[-1]):
            open_from = 0
        if held and (open_from or (held[0].column("cell")[0].as_py(), held[0].column("deal")[0].as_py()) != (cell[0], deal[0])):
            yield linked(pa.Table.from_batches([*held, batch.slice(0, open_from)]).combine_chunks())
            held = []
        elif open_from:
            yield linked(pa.Table.from_batches([batch.slice(0, open_from)]).combine_chunks())
        held.append(batch.slice(open_from))
    if held:
        yield linked(pa.Table.from_batches(held).combine_chunks())


def loose_links(classes: DataFrame, band_bits: int, tables: int, cell_limit: int) -> DataFrame:
    """(a, b): nodes that connect all classes with a common band and near sketches."""
    cells = _cells(classes, band_bits, tables)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > cell_limit), "cells")
    nothing = F.lit(0).cast("bigint").alias("deal")
    entries = cells
    if not large.isEmpty():
        entries = cells.join(large, "cell", "left_anti")
    entries = entries.select("*", nothing, F.lit(0).alias("side"))
    if not large.isEmpty():
        parts = F.ceil(F.col("n") / (cell_limit // 2))
        dealt = _dealt(cells.join(large, "cell"), "cell", parts, F.col("node"))
        entries = entries.unionByName(dealt.drop("n"))
    first, second = simhash.gray_ranks(F.col("s0"), F.col("s1"))
    in_cells = (
        entries.repartition("cell", "deal")
        .withColumns({"r0": first, "r1": second})
        .sortWithinPartitions("cell", "deal", "r0", "r1")
        .drop("r0", "r1")
    )
    return map_batches(in_cells, _sketch_links, "a bigint, b bigint")


def similar_pairs(sets: list[np.ndarray], similarity: float):
    """(i, j) arrays, j < i, of sets with at least that Jaccard similarity, one i at a time."""
    sizes = np.array([len(s) for s in sets])
    until = np.concatenate([[0], np.cumsum(sizes)])
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), sizes)[np.argsort(number, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(number))])
    for i in range(1, len(sets)):
        own = number[until[i] : until[i + 1]]
        counts = first[own + 1] - first[own]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        shared = np.bincount(holder[at + np.repeat(first[own], counts)], minlength=len(sets))[:i]
        either = sizes[i] + sizes[:i] - shared
        j = np.flatnonzero(shared >= 1)
        j = j[shared[j] / either[j] >= similarity]
        if len(j):
            yield np.full(len(j), i), j


def _verifier(similarity: float, shingle: int):
    """node pairs: a spanning forest of the true links in each blob or deal."""

    def run(batches):
        for rows in local_links.runs(batches, ["blob", "deal"]):
            if rows.num_rows < 2:
                continue
            node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
            sets = [shingle_set(words_of(text), shingle) for text in rows.column("text").to_pylist()]
            labels = np.arange(len(sets))
            for i, j in similar_pairs(sets, similarity):
                meets = (side[i] == 0) | (side[i] != side[j])
                labels = local_links.merge(labels, i[meets], j[meets])
            moved = np.flatnonzero(labels != np.arange(len(sets)))
            if len(moved):
                ends = [pa.array(node[x]) for x in (moved, labels[moved])]
                yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    return run


def _with_class(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the class of their text as a column ``name`` after their own."""

    def run(batches):
        for part in slices(batches):
            found = [class_of(words_of(text)) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found, pa.string())], [*part.schema.names, name]
            )

    return map_batches(rows, run, T.StructType([*rows.schema, T.StructField(name, T.StringType())]))


def _labelled(
    docs: DataFrame, similarity: float, shingle: int, band_bits: int, tables: int,
    cell_limit: int, part_texts: int,
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, class) of all rows, (class, first_id, component) of all classes)."""
    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    band_words = -(-band_bits * tables // 64)
    schema = "doc_id bigint, class string, bands binary, s0 bigint, s1 bigint"
    prints = stored(map_batches(narrow, _printer(shingle, band_words), schema), "prints")
    kinds = prints.groupBy("class").agg(
        F.min("doc_id").alias("first_id"), *[F.any_value(c).alias(c) for c in ("bands", "s0", "s1")]
    )
    classes = stored(kinds.withColumn("node", F.monotonically_increasing_id()), "classes")
    blobs = connected_components(loose_links(classes, band_bits, tables, cell_limit))
    members = blobs.withColumnRenamed("component", "blob").join(
        classes.select("node", "class", "first_id"), "node"
    )
    # The text of one row of each class; other copies are left out before anything is grouped.
    texts = _with_class(narrow, "class").withColumnRenamed("doc_id", "first_id")
    found = texts.join(
        members,
        (texts["class"] == members["class"]) & texts["first_id"].eqNullSafe(members["first_id"]),
    ).select("node", "blob", "text")
    found = stored(found.dropDuplicates(["node"]), "blobs")
    sizes = found.groupBy("blob").agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")
    )
    parts = F.greatest(F.ceil(F.col("n") / part_texts), F.ceil(F.col("bytes") / PART_BYTES), F.lit(1))
    dealt = _dealt(found.join(sizes.where("n > 1"), "blob"), "blob", parts, F.col("node"))
    together = (
        dealt.select("blob", "deal", "node", "side", "text")
        .repartition("blob", "deal")
        .sortWithinPartitions("blob", "deal", "node")
    )
    links = map_batches(together, _verifier(similarity, shingle), "a bigint, b bigint")
    groups = connected_components(links)
    labels = classes.select("node", "class", "first_id").join(groups, "node", "left")
    component = F.coalesce("component", "node").alias("component")
    return prints.select("doc_id", "class"), stored(labels.select("class", "first_id", component), "labels")


def near_copies(
    docs: DataFrame,
    *,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    band_bits: int = BAND_BITS,
    tables: int = TABLES,
    cell_limit: int = CELL_LIMIT,
    part_texts: int = PART_TEXTS,
) -> DataFrame:
    """doc_id, class, component_id of every row of ``docs`` (doc_id, text).

    ``class`` names texts with the same words; ``component_id`` is the smallest doc_id that links of at
    least ``similarity`` reach, null where no row has one. A text with fewer words than ``shingle`` is
    one shingle; texts without words, null or empty, are one class. Repeated rows give repeated rows;
    an empty table gives no rows; other columns are not read. Links are never wrong; about one in eleven
    with a similarity of just 0.8 is not found by itself, far fewer above. More than about 10 ** 9
    classes want wider bands and more tables.
    """
    settings = similarity, shingle, band_bits, tables, cell_limit, part_texts
    rows, labels = _labelled(docs, *settings)
    least = labels.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(labels.join(least, "component").select("class", "component_id"), "components")
    return rows.join(named, "class").select("doc_id", "class", "component_id")


def keep_one(
    docs: DataFrame,
    *,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    band_bits: int = BAND_BITS,
    tables: int = TABLES,
    cell_limit: int = CELL_LIMIT,
    part_texts: int = PART_TEXTS,
) -> DataFrame:
    """One row of each group of near copies in ``docs``, with all its columns as they are.

    It is the row with the smallest doc_id; rows without one come last, and of several with one doc_id
    the first by class and then by all columns. A doc_id that different texts share is no reason to
    drop any of them.
    """
    settings = similarity, shingle, band_bits, tables, cell_limit, part_texts
    rows, labels = _labelled(docs, *settings)
    order = F.struct(F.col("first_id").isNull().alias("nameless"), "first_id", "class")
    chosen = labels.groupBy("component").agg(F.min(order).alias("kept")).select("kept.first_id", "kept.class")
    chosen = stored(chosen, "kept")
    name = "class"
    while name in docs.columns:
        name += "_"
    own = _with_class(docs, name)

    def matching(other: DataFrame) -> Column:
        same_id = own["doc_id"].cast("bigint").eqNullSafe(other["first_id"])
        return (own[name] == other["class"]) & same_id

    # The same plan at every size: what is kept grows with the documents and is no broadcast.
    kept = own.join(chosen.hint("merge"), matching(chosen), "left_semi")
    counts = rows.groupBy(F.col("doc_id").alias("first_id"), "class").agg(F.count("*").alias("n"))
    repeated = stored(counts.where("n > 1").select("first_id", "class"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    place = "place"
    while place in kept.columns:
        place += "_"
    # Maps have no order.
    sortable = [f"`{f.name}`" for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    in_order = Window.partitionBy(name, "doc_id").orderBy(*sortable)
    again = kept.join(repeated, matching(repeated), "left_semi").withColumn(
        place, F.row_number().over(in_order)
    )
    once = kept.join(repeated, matching(repeated), "left_anti").select(*docs.columns)
    return once.unionByName(again.where(F.col(place) == 1).select(*docs.columns))
