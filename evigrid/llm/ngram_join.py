"""N-gram Jaccard join: a grouped prefix join on word shingles, then connected components.

Documents with the same prefix and set size form one group; groups, not documents, meet at prefix shingles;
the groups that meet are expanded to their members, and the members' whole sets are compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigrid.llm.common import bit_of, bitmap, checkpointed, few, in_bitmap, lent, table, thrifty
from evigrid.llm.graph import components
from evigrid.llm.hashing import U, mix, shingle_sets

#: Counters of the frequency sketch that orders shingles: 4 bytes each, 16 MB on every executor whatever the input's size.
SKETCH_BITS = 22
#: Rows of the sketch that travel together.
_SLICES = 256
#: Regions of the hash space whose counts bound the overlap of two sets: bytes of a member's outline.
REGIONS = 128
#: Members that are compared in one go; larger meetings are split into blocks.
BLOCK = 256


def _sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many documents hold a shingle of each hash slot: an upper bound of every shingle's frequency.

    Each task counts its own rows and sends one bounded array; sums are streamed slice by slice.
    """
    width = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                counts[(s & U((1 << bits) - 1)).astype(np.int64)] += 1
        if counts.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "counts": pa.array([zlib.compress(counts[i * width : (i + 1) * width].tobytes(), 1) for i in range(_SLICES)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(b), np.uint32).astype(np.uint64)
                sums[i] = sums[i] + part if i in sums else part
        if sums:
            yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(x, (1 << 32) - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())})

    schema = "slice int, counts binary"
    out = np.zeros(1 << bits, np.uint32)
    for row in docs.select("text").mapInArrow(thrifty(count), schema).repartition("slice").mapInArrow(thrifty(add), schema).collect():
        out[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(bytes(row["counts"]), np.uint32)
    return out


def _prefixes(docs: DataFrame, k: int, percent: int, sketch) -> DataFrame:
    """Per document: its set's size, a 128-bit key of the set, its prefix (the rarest shingles), a key of prefix and size, and its outline (how many shingles lie in each region of the hash space)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        mask = U(len(counts) - 1)
        for batch in batches:
            n, one, two, key, prefix, outline = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                size = len(s)
                n.append(size)
                one.append(mix(s).sum(dtype=U) if size else U(0))
                two.append(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) if size else U(0))
                keep = size - -(-percent * size // 100) + 1 if size else 0
                rare = s[np.argsort(counts[(s & mask).astype(np.int64)], kind="stable")[:keep]]
                prefix.append(rare.view(np.int64))
                counts_by_region = np.bincount((s >> U(64 - REGIONS.bit_length() + 1)).astype(np.int64), minlength=REGIONS)
                outline.append(np.minimum(counts_by_region, 255).astype(np.uint8).tobytes())
                key.append(mix(np.array([mix(rare).sum(dtype=U) ^ mix(np.array([size], U))[0]], U))[0])
            lengths = np.array([len(x) for x in prefix], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(one, U).view(np.int64)),
                    pa.array(np.array(two, U).view(np.int64)),
                    pa.array(np.array(key, U).view(np.int64)),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *prefix])),
                    pa.array(outline, pa.binary()),
                ],
                ["doc_id", "n", "c1", "c2", "g", "prefix", "outline"],
            )

    return docs.mapInArrow(thrifty(prefixes), "doc_id long, n long, c1 long, c2 long, g long, prefix array<long>, outline binary")


def _sets(docs: DataFrame, k: int, wanted) -> DataFrame:
    """Whole sets of the documents that the bitmap lets pass."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            take = np.flatnonzero(in_bitmap(bits, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(take):
                continue
            some = batch.take(pa.array(take))
            found = [s for _, s in shingle_sets(some.column(2), k)]
            c1 = np.array([mix(s).sum(dtype=U) for s in found], U)
            c2 = np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) for s in found], U)
            lengths = np.array([len(s) for s in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *(s.view(np.int64) for s in found)]))],
                ["doc_id", "c1", "c2", "set"],
            )

    return docs.select("doc_id", bit_of(F.xxhash64("doc_id")).alias("bit"), "text").mapInArrow(thrifty(sets), "doc_id long, c1 long, c2 long, set array<long>")


def _linked(sets: list[np.ndarray], label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what is similar among the sets: a spanning forest of the similarity graph over what the labels leave apart.

    A member is compared with all that are not yet connected to it, through posting lists, so that no link is missed;
    members already connected need no comparison.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        if label[0] == label[1]:
            return []
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) else []
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    flat = flat[order]
    links = []
    waiting = np.ones(n, bool)
    while waiting.any():
        seed = int(np.flatnonzero(waiting)[0])
        waiting[seed] = False
        queue = [seed]
        same = waiting & (label == label[seed])
        waiting &= ~same
        queue += np.flatnonzero(same).tolist()
        while queue and waiting.any():
            a = queue.pop()
            low, high = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
            lengths = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            both = np.bincount(owner[at], minlength=n)
            near = waiting & (100 * both >= percent * (sizes[a] + sizes - both))
            for b in np.flatnonzero(near):
                if not waiting[b]:
                    continue
                links.append((a, int(b)))
                group = waiting & (label == label[b])
                group[b] = True
                waiting &= ~group
                queue += np.flatnonzero(group).tolist()
    return links


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with the same first two columns, each as a list of slices."""
    now, rows = None, []
    for batch in batches:
        if not len(batch):
            continue
        token, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cuts = [0, *(np.flatnonzero((np.diff(token) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = (int(token[a]), int(part[a]))
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(batch.slice(a, b - a))
    if rows:
        yield now, rows


def _promising(members: DataFrame, percent: int) -> DataFrame:
    """The members (token, part, doc_id, c1, c2, label, pivot, met: how many they are, head: one of them) of each meeting with a partner there whose outline does not rule a link out.

    Two sets share at most the sum over regions of the smaller count; a region that is full (255) bounds nothing.
    Members that carry one label already need no link between them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _meetings(batches):
            group = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            if len(group) < 2:
                continue
            n, label = group.column(7).to_numpy(), group.column(5).to_numpy()
            shape = np.frombuffer(b"".join(group.column(8).to_pylist()), np.uint8).reshape(len(group), REGIONS)
            full = (shape == 255).any(axis=1)
            good = np.zeros(len(group), bool)
            for i in range(len(group) - 1):
                most = np.minimum(shape[i], shape[i + 1 :]).sum(axis=1, dtype=np.int64)
                most = np.where(full[i] | full[i + 1 :], np.minimum(n[i], n[i + 1 :]), most)
                near = (most * (100 + percent) >= percent * (n[i] + n[i + 1 :])) & (label[i] != label[i + 1 :])
                if near.any():
                    good[i] = True
                    good[i + 1 :] |= near
            if good.any():
                some = group.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays([*some.columns[:7], pa.array(np.full(len(some), len(some), np.int32)), pa.array(np.full(len(some), some.column(2)[0].as_py()))], [*some.schema.names[:7], "met", "head"])

    dealt = members.select("token", "part", "doc_id", "c1", "c2", "label", "pivot", "n", "outline").repartition("token", "part").sortWithinPartitions("token", "part")
    return dealt.mapInArrow(thrifty(run), "token long, part int, doc_id long, c1 long, c2 long, label long, pivot boolean, met int, head long")


def _verified(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found among the rows of each (token, part); a row: token, part, doc_id, label, set."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _meetings(batches):
            ids = np.concatenate([r.column(2).to_numpy() for r in rows])
            labels = np.concatenate([r.column(3).to_numpy() for r in rows])
            sets = [x.values.to_numpy().view(U) for r in rows for x in r.column(4)]
            links = _linked(sets, labels, percent) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_pydict({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})

    dealt = members.select("token", "part", "doc_id", "label", "set").repartition("token", "part").sortWithinPartitions("token", "part")
    return dealt.mapInArrow(thrifty(verify), "a long, b long")


def _links(docs: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """Links among the members (token, part, doc_id, c1, c2, label) of each meeting, by their whole sets."""
    members = checkpointed(members)
    if members.isEmpty():  # else the join would end before its other side, which still reads the bitmap
        return docs.sparkSession.createDataFrame([], "a long, b long")
    with lent(docs.sparkSession, bitmap(members, bit_of(F.xxhash64("doc_id")))) as wanted:
        return checkpointed(_verified(members.join(_sets(docs, k, wanted), ["doc_id", "c1", "c2"]), percent))


def _can_link(x, y, percent: int):
    """Whether two groups that meet at a shingle can be similar enough, by their places there (size * 2**31 + position in the prefix).

    What two sets share from their first common shingle on is no more than what either has left. Any later common
    shingle may be refused where the first one is not, so that no link is lost.
    """
    low = F.lit((1 << 31) - 1)
    sizes = [F.shiftright(p, 31) for p in (x, y)]
    rest = F.least(*(n - p.bitwiseAND(low) for n, p in zip(sizes, (x, y), strict=True)))
    return rest * F.lit(100 + percent) >= (sizes[0] + sizes[1]) * F.lit(percent)


def _in_blocks(members: DataFrame) -> DataFrame:
    """Rows of large meetings (token, doc_id, label, ...), dealt to parts such that any two with different labels share one.

    Members with a meeting's most frequent label, its bulk, need none of each other: each lies in one block, which meets
    all blocks of the others; so a meeting that is nearly connected takes little more than its own number of rows.
    """
    counts = members.groupBy("token", "label").agg(F.count("*").alias("c"))
    of_token = few(counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("bulk"), F.sum("c").alias("all")))
    half, salted = F.lit(BLOCK // 2), F.xxhash64("doc_id", F.lit(3))
    rows = members.join(of_token, "token").withColumns({"ours": F.ceil(F.col("bulk") / half), "theirs": F.ceil((F.col("all") - F.col("bulk")) / half)})
    width, bulk = F.lit(1 << 15), F.col("label") == F.col("top")
    i, j = F.pmod(salted, F.greatest("theirs", F.lit(1))), F.pmod(salted, F.col("ours"))
    with_bulk = F.transform(F.sequence(F.lit(0).cast("long"), F.col("ours") - 1), lambda x: i * width + x)
    among = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("theirs", F.lit(1)) - 1), lambda x: -(F.least(i, x) * width + F.greatest(i, x)) - 1)
    mine = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("theirs", F.lit(1)) - 1), lambda x: x * width + j)
    return rows.withColumn("part", F.explode(F.when(bulk, mine).otherwise(F.concat(with_bulk, among)).cast("array<int>")))


def similar_documents(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct k-word
    shingles, or its whole word sequence where that is shorter. Two documents link when
    100 * |intersection| >= percent * |union|; component_id is the smallest doc_id reachable by links.

    1. Shingles are ordered by a fixed-size frequency sketch, rarest first (any fixed order is right; this one keeps meetings small).
    2. Equal prefix and size: one group; equal sets inside it: one member, its smallest doc_id.
    3. A prefix shingle that two members share is a meeting. Meetings of the same groups count once.
    4. Members with a partner that their outlines do not rule out form families over their meetings; a family of up to BLOCK is
       compared once, by its members' whole sets. In wider ones each member is first compared in its largest meeting (one of
       over BLOCK members goes in hashed blocks, with a few members in every block), then in all its meetings, but only
       where they are still apart (or once with all the family, if that is less). Only a spanning forest of the links is kept.
    5. Connected components of the links.

    Null or empty text: empty set, linked with nothing. A null doc_id takes no part and has a null component_id.
    Repeated rows give repeated result rows. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with lent(spark, _sketch(docs, k)) as sketch:
        known = checkpointed(_prefixes(docs, k, percent, sketch))
    linkable = known.where("n > 0 AND doc_id IS NOT NULL")
    classes = checkpointed(linkable.groupBy("g", "n", "c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.first("outline").alias("outline")))
    groups = linkable.groupBy("g", "n").agg(F.first("prefix").alias("prefix")).join(classes.groupBy("g", "n").agg(F.count("*").alias("m")), ["g", "n"])
    meetings = groups.select("g", "m", (F.col("n") * F.lit(1 << 31)).alias("big"), F.posexplode("prefix").alias("at", "token")).select("token", "g", "m", (F.col("big") + F.col("at")).alias("place")).repartition("token")
    met = meetings.groupBy("token").agg(F.sum("m").alias("size"), F.count("*").alias("groups"), F.bit_xor(F.xxhash64("g")).alias("who"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("who2"), F.min("place").alias("x"), F.max("place").alias("y"))
    # members of one group are alike whatever the other group is, so only two groups of one member each can be refused
    met = met.where("size > 1").where((F.col("groups") > 2) | (F.col("size") > F.col("groups")) | _can_link(F.col("x"), F.col("y"), percent))
    chosen = met.groupBy("size", "who", "who2").agg(F.min("token").alias("token"))
    present = checkpointed(
        meetings.join(chosen.select("token", "size"), "token").select("token", "size", "g").join(classes, "g").select("token", "size", "doc_id", "c1", "c2", "n", "outline")
    )
    blocks = F.when(F.col("size") > BLOCK, F.ceil(F.col("size") * 2 / BLOCK)).otherwise(1).cast("int")
    own = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("doc_id", F.lit(3)), blocks)).otherwise(F.lit(0)).cast("int")
    columns = ["token", "part", "doc_id", "c1", "c2", "label", "pivot", "n", "outline"]
    first = present.withColumns({"part": own, "label": F.col("doc_id"), "pivot": F.lit(False)}).select(columns)
    large = present.where(F.col("size") > BLOCK)
    some = not large.isEmpty()
    if some:
        pivots = large.groupBy("token", "size").agg(*(F.min_by(F.struct("doc_id", "c1", "c2", "n", "outline"), F.xxhash64("doc_id", F.lit(10 + i))).alias(f"p{i}") for i in range(4)))
        pivots = pivots.select("token", "size", F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(4))))).alias("p"))
        pivots = pivots.select("token", "p.*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part")).withColumns({"label": F.col("doc_id"), "pivot": F.lit(True)})
        first = first.unionByName(pivots.select(columns))
    met = checkpointed(_promising(first, percent))
    member, key = ["doc_id", "c1", "c2"], ["token", "part", "doc_id", "c1", "c2", "label"]
    near = met.select("doc_id", "head")
    if some:
        near = near.unionByName(large.select("token", "doc_id").join(large.groupBy("token").agg(F.min("doc_id").alias("head")), "token").select("doc_id", "head"))
    family = components(near, "doc_id", "head", contract=True).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    sizes = few(checkpointed(family.groupBy("family").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)))
    once = met.select(*member, "label").distinct().join(family.join(sizes, "family", "left_anti"), "doc_id").select(F.col("family").alias("token"), F.lit(-1).alias("part"), *member, "label")
    links = _links(docs, once, k, percent)
    edges = links
    wide = checkpointed(family.join(sizes, "family").select("doc_id", "family", "k"))
    if not wide.isEmpty():
        rest = met.join(wide.select("doc_id"), "doc_id")
        largest = rest.where("NOT pivot").groupBy(*member).agg(F.max(F.struct("met", "token", "part")).alias("m"), F.first("label").alias("label"))
        edges = links.unionByName(_links(docs, largest.select("m.token", "m.part", *member, "label").unionByName(rest.where("pivot").select(key)), k, percent))
        found = checkpointed(components(edges, contract=True)).withColumnRenamed("node", "doc_id")
        named = checkpointed(present.join(wide, "doc_id").join(found, "doc_id", "left").withColumns({"label": F.coalesce("component", "doc_id"), "pivot": F.lit(False), "part": F.lit(0)}))
        apart = named.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
        named = checkpointed(named.join(apart, "token"))
        # a family's meetings overlap: where comparing all its members takes fewer rows than all its meetings, it is one meeting
        cost = few(checkpointed(named.groupBy("family", "k").agg(F.sum(blocks).alias("rows")).where(F.col("k") * F.ceil(F.col("k") * 2 / BLOCK) <= F.col("rows")).select("family")))
        one = named.join(cost, "family", "left_semi").groupBy("doc_id", "c1", "c2").agg(*(F.first(c).alias(c) for c in ("label", "n", "outline", "family", "k")))
        one = one.select(F.col("family").alias("token"), F.col("k").alias("size"), F.lit(0).alias("part"), "doc_id", "c1", "c2", "label", F.lit(False).alias("pivot"), "n", "outline")
        named = one.unionByName(named.join(cost, "family", "left_anti").select(one.columns))
        second = named.where(F.col("size") <= BLOCK).select(columns).unionByName(_in_blocks(named.where(F.col("size") > BLOCK)).select(columns))
        known_edges = found.select(F.col("doc_id").alias("a"), F.col("component").alias("b"))  # stars already: few rounds more
        edges = known_edges.unionByName(_links(docs, _promising(second, percent).select(key), k, percent))
    found = components(edges, contract=True)
    labelled = classes.select("c1", "c2", "n", F.col("doc_id").alias("least")).join(found, F.col("least") == F.col("node"), "left").select("c1", "c2", "n", F.coalesce("component", "least").alias("component_id"))
    return known.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2", "n").join(labelled, ["c1", "c2", "n"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, similarity of 0.9 or more."""
    return similar_documents(table(spark, sf_dir, "documents"), 3, 90)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) END AS sh FROM w
), t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (
  WITH RECURSIVE reach(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.d WHERE reach.c < e.b)
  SELECT d, min(c) AS c FROM reach GROUP BY d
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, r.c AS component_id FROM s JOIN r ON r.d = s.doc_id
"""
