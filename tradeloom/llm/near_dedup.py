"""MinHash near-dedup by an inverted join on signature coordinates.

Documents of equal shingle sets form a class, and its smallest id goes on. A
signature has COORDS coordinates; two sets of similarity 0.75 agree on fewer
than MATCHES of them with a chance of 5e-11. Every (coordinate, value) pair that
more than one class has is posted. A document posts only the rarest of its pairs
that it needs: two documents that agree on MATCHES pairs share one of the
COORDS - MATCHES + 1 rarest of each (prefix filter; pairs that nobody else has
count as the rarest and are skipped). Lists of the same members are merged into
one. Within a list, collisions of whole signatures are counted; of the pairs at
the threshold only a spanning forest is emitted, never the pairs. The forest's
components are groups of candidates. Within a group intersections of full
shingle sets are counted, and again a spanning forest of the links goes on.

A list or group that fits one block is compared in one task. A larger one is
split into blocks: first every member is compared with `PIVOTS` members of it.
What is linked through pivots is one part; the members outside of the largest
part - linked with no pivot, or with pivots of another part - are compared with
all. So a hot group of n near copies costs n comparisons with pivots, and only
the members outside cost more. Blocks of sets are bounded in shingles.

Edge cases: a null text or one without words has an empty set, is linked with
nothing and kept; fewer than five words make one shingle; very long texts are
taken whole; repeated rows are in one class; rows of one doc_id with different
texts are linked by that id, as a link reaches all texts of it; a null doc_id is
linked with nothing, its component_id is null and it is kept; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, materialize, table
from .graph import components

COORDS, MATCHES, WIDTH, PERCENT = 64, 24, 5, 75
#: Members of a posting list, and shingles of a group of candidates, in one block; members that all others are compared with first.
LIST_BLOCK, GROUP_BLOCK, PIVOTS = 2048, 250_000, 3


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts, width: int = WIDTH, hashes: WordHashes | None = None) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; A-Z are lower-cased."""
    hashes = hashes or WordHashes()
    return [_shingles(h, width) for h in hashes.many([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])]


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    if not len(h):
        return h
    k = min(width, len(h))
    n = len(h) - k + 1
    s = h[:n].copy()
    for i in range(1, k):
        s = _mix(s) + h[i : n + i]
    return np.unique(_mix(s + np.uint64(k)))


def _multipliers(coords: int) -> np.ndarray:
    return (_mix(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1))[:, None]


def _signature(s: np.ndarray, by: np.ndarray) -> np.ndarray:
    out = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, ((by * s[i : i + 4096]) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return out


def sketch(docs: DataFrame, width: int = WIDTH, coords: int = COORDS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null: empty), signature."""

    def run(batches):
        by, hashes = _multipliers(coords), WordHashes()
        for b in batches:
            rows = []
            for doc, s in zip(b["doc_id"], shingles(b["text"], width, hashes), strict=True):
                if len(s):
                    rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), _signature(s, by).view(np.int32)))
                else:
                    rows.append((doc, 0, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n_shingles long, digest binary, sig array<int>")


def _runs(batches, keys: list[str]):
    """(frame, bounds): whole runs of equal keys, from batches sorted by keys; bounds has where each begins, and the end."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            cuts = np.concatenate(([0], cuts))
        if not len(cuts):
            held.append(b)
            continue
        one = pd.concat([*held, b.iloc[: cuts[-1]]])
        k = one[keys].to_numpy()
        yield one, np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, [len(one)]))
        held = [b.iloc[cuts[-1] :]]
    if held:
        one = pd.concat(held)
        yield one, np.array([0, len(one)])


def _forest(ids: np.ndarray, near: np.ndarray):
    """Star edges over the components of a symmetric boolean matrix."""
    left = near.any(axis=1)
    for i in range(len(ids)):
        if not left[i]:
            continue
        seen = near[i].copy()
        seen[i] = True
        todo = list(np.flatnonzero(seen & left))
        left[i] = False
        while todo:
            j = todo.pop()
            if left[j]:
                left[j] = False
                new = near[j] & ~seen
                if new.any():
                    seen |= new
                    todo.extend(np.flatnonzero(new & left))
        left &= ~seen
        for j in np.flatnonzero(seen):
            if j != i:
                yield int(ids[i]), int(ids[j])


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _apart(reached: DataFrame, pivots: int) -> DataFrame:
    """(key, own, id, mask of the pivots that a member is linked with) -> (key, id) of the members outside of their key's largest part.

    A part is what is linked through pivots: masks that share a bit are one. Two
    members of one part need no comparison; of two others one is outside of the
    largest part, and is to be compared with all.
    """
    reached = reached.groupBy("key", "own", "id").agg(F.bit_or("mask").alias("mask"))
    # A few rows a key, whatever its members.
    masks = reached.groupBy("key", "own", "mask").agg(F.count("*").alias("c"))
    met = masks.where("mask <> 0").groupBy("key").agg(F.collect_set("mask").alias("met"))
    part = F.col("mask")
    for _ in range(pivots):
        part = F.aggregate("met", part, lambda a, x: F.when(a.bitwiseAND(x) != 0, a.bitwiseOR(x)).otherwise(a))
    parts = materialize(masks.join(met, "key").select("key", "own", "mask", part.alias("part"), "c"))
    sizes = parts.where("part <> 0").groupBy("key", "part").agg(F.sum("c").alias("c"))
    largest = sizes.groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("largest"))
    outside = parts.join(largest, "key").where("part <> largest").select("key", "own", "mask")
    return materialize(reached.join(outside, ["key", "own", "mask"], "left_semi").select("key", "id"))


def forest(members: DataFrame, payload: str, links, block: int, pivots: int = PIVOTS) -> DataFrame:
    """(key, id, weight, payload) -> edges (a, b): a spanning forest of the linked pairs of each key.

    links(payloads, rows, columns) gives the boolean matrix of links between the
    payloads at the positions rows and those at the positions columns.
    """
    members = materialize(members)
    size = members.groupBy("key").agg(F.sum("weight").alias("size"), F.count("*").alias("m")).where("m > 1")
    members = members.join(size.select("key", F.ceil(F.col("size") / block).cast("int").alias("n")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    small, large = members.where("n = 1"), members.where("n > 1")

    def all_pairs(batches):
        for g, bounds in _runs(batches, ["key"]):
            ids, what, edges = g["id"].to_numpy(), g[payload].to_list(), []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j - i > 1:
                    every = np.arange(j - i)
                    near = links(what[i:j], every, every)
                    np.fill_diagonal(near, False)
                    edges += _forest(ids[i:j], near)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    out = _dealt(small.select("key", "id", payload), "key").mapInPandas(all_pairs, "a long, b long")
    # Written, so that nothing after it inherits a dealing by key, which would leave a hot key to one task.
    large = materialize(large.select("key", "id", "n", "own", payload))
    if large.isEmpty():
        return out
    # The members of least hash, by one partial aggregate for each.
    least = [F.min(F.struct(F.xxhash64(F.lit(k), F.col("id")).alias("h"), "id", payload)).alias(f"p{k}") for k in range(pivots)]
    chosen = large.groupBy("key").agg(F.max("n").alias("n"), *least)
    chosen = chosen.select("key", F.array(*[f"p{k}" for k in range(pivots)]).alias("p"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("own"))
    chosen = chosen.select("key", "own", F.posexplode("p").alias("rank", "p")).select("key", "own", F.col("p.id").alias("id"), F.col(f"p.{payload}").alias(payload), "rank")

    def with_pivots(batches):
        for g, bounds in _runs(batches, ["key", "own"]):
            key, own, ids, rank, what, rows = g["key"].to_numpy(), g["own"].to_numpy(), g["id"].to_numpy(), g["rank"].to_numpy(), g[payload].to_list(), []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                lead, rest = np.flatnonzero(rank[i:j] < pivots), np.flatnonzero(rank[i:j] == pivots)
                near = links(what[i:j], rest, lead) | (ids[i:j][rest][:, None] == ids[i:j][lead][None, :])
                rows += [(key[i], own[i], ids[i:j][r], ids[i:j][c], 0) for r, c in zip(rest[np.nonzero(near)[0]], lead[np.nonzero(near)[1]], strict=True)]
                rows += [(key[i], own[i], ids[i:j][r], None, m) for r, m in zip(rest, near @ (1 << rank[i:j][lead].astype(np.int64)), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "own", "a", "b", "mask"]).astype({"key": "int64", "own": "int32", "a": "int64", "b": "Int64", "mask": "int64"})

    both = large.select("key", "own", "id", payload, F.lit(pivots).alias("rank")).unionByName(chosen)
    first = materialize(both.repartition("key", "own").sortWithinPartitions("key", "own", "rank").mapInPandas(with_pivots, "key long, own int, a long, b long, mask long"))
    out = out.unionByName(first.where("b IS NOT NULL AND a <> b").select("a", "b"))
    left = _apart(first.where("b IS NULL").select("key", "own", F.col("a").alias("id"), "mask"), pivots)
    if left.isEmpty():
        return out
    # Those apart, in blocks of their own, meet every block of all members.
    few = left.join(large, ["key", "id"])
    many = left.groupBy("key").agg(F.count("*").alias("u"))
    each = large.groupBy("key").agg(F.count("*").alias("m"), F.max("n").alias("n")).join(many, "key")
    each = each.select("key", F.ceil(F.col("u") * F.col("n") / F.col("m")).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("own"))
    # A row for each block, so that the members of a hot key are joined block by block and not all in one task.
    few = few.join(each, ["key", "own"]).withColumn("lo", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")).withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    all_ = large.join(each, ["key", "own"]).withColumnRenamed("own", "hi").withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    both = few.select("key", "lo", "hi", "id", payload, F.lit(0).alias("rank")).unionByName(all_.select("key", "lo", "hi", "id", payload, F.lit(1).alias("rank")))

    def rest_pairs(batches):
        for g, bounds in _runs(batches, ["key", "lo", "hi"]):
            ids, rank, what, edges = g["id"].to_numpy(), g["rank"].to_numpy(), g[payload].to_list(), []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                a, b = np.flatnonzero(rank[i:j] == 0), np.flatnonzero(rank[i:j] == 1)
                if len(a) and len(b):
                    near = np.zeros((j - i, j - i), bool)
                    near[np.ix_(a, b)] = links(what[i:j], a, b) & (ids[i:j][a][:, None] != ids[i:j][b][None, :])
                    edges += _forest(ids[i:j], near | near.T)
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return out.unionByName(_dealt(both, "key", "lo", "hi").mapInPandas(rest_pairs, "a long, b long"))


def _agreeing(matches: int):
    def links(sigs, rows, columns):
        s = np.stack(sigs)
        hits = np.zeros((len(rows), len(columns)), np.uint8)
        for c in s.T:
            hits += c[rows][:, None] == c[columns][None, :]
        return hits >= matches

    return links


def _alike(percent: int):
    def links(sets, rows, columns):
        sets = [np.frombuffer(x, np.uint64) for x in sets]
        n = np.array([len(x) for x in sets])
        common = intersections(sets, rows, columns)
        return 100 * common >= percent * (n[rows][:, None] + n[columns][None, :] - common)

    return links


def candidates(sketches: DataFrame, coords: int = COORDS, matches: int = MATCHES, block: int = LIST_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(id, sig) of classes -> edges (a, b): a spanning forest of the pairs that agree on `matches` coordinates."""
    post = sketches.select("id", F.posexplode("sig").alias("c", "v")).select("id", (F.col("c").cast("long") * (1 << 32) + F.col("v").cast("long") + (1 << 31)).alias("key"))
    shared = post.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    lists = post.join(shared, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("p"))
    lists = lists.where(F.size("p") >= matches).select("id", F.slice("p", 1, F.size("p") - F.lit(matches - 1)).alias("p"))
    posted = materialize(lists.select("id", F.explode("p").alias("p")).select("id", "p.key"))
    # Lists of the same members give the same links: one of them is enough. Lists of one give none.
    same = [F.bit_xor(F.xxhash64(F.lit(k), F.col("id"))).alias(f"x{k}") for k in (1, 2)]
    lists = posted.groupBy("key").agg(*same, F.count("*").alias("m")).where("m > 1").groupBy("x1", "x2", "m").agg(F.min("key").alias("key"))
    posted = posted.join(lists.select("key"), "key", "left_semi").join(sketches.hint("merge"), "id")
    return forest(posted.select("key", "id", F.lit(1).alias("weight"), "sig"), "sig", _agreeing(matches), block, pivots)


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at `rows` with those at `columns`, as products of 0/1 matrices over the shingles that two sets or more have."""
    m = len(sets)
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    col, row = number[inverse], np.repeat(np.arange(m), [len(s) for s in sets])
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, step, total = np.zeros((len(rows), len(columns)), np.float32), max(256, 4_000_000 // m), int((counts > 1).sum())
    for at in range(0, total, step):
        i, j = np.searchsorted(col, (at, at + step))
        x = np.zeros((m, min(step, total - at)), np.float32)
        x[row[i:j], col[i:j] - at] = 1
        out += x[rows] @ x[columns].T
    return out.astype(np.int64)


def confirm(docs: DataFrame, groups: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = GROUP_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Within groups (id, component, digest): edges of a spanning forest of the links confirmed on full sets."""
    # The same join at every size: what goes through the shuffle then follows the input.
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(groups.hint("merge"), "id")

    def sets(batches):
        hashes = WordHashes()
        for b in batches:
            s = [x.tobytes() for x in shingles(b["text"], width, hashes)]
            yield pd.DataFrame({"key": b["component"], "id": b["id"], "weight": [len(x) // 8 for x in s], "s": s, "same": [xxhash.xxh3_128_digest(x) == d for x, d in zip(s, b["digest"], strict=True)]})

    rows = texts.select("id", "component", "digest", "text").mapInPandas(sets, "key long, id long, weight long, s binary, same boolean")
    # Of rows that share a doc_id the one that stands for its class; repeated rows once.
    rows = rows.where("same").drop("same").dropDuplicates(["id", "s"])
    return forest(rows, "s", _alike(percent), block, pivots)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    every = materialize(sketch(docs, width, coords))
    full = every.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = materialize(full.groupBy("digest").agg(F.min("doc_id").alias("id")))
    heads = full.join(first.withColumnRenamed("id", "doc_id"), ["digest", "doc_id"], "left_semi").dropDuplicates(["doc_id", "digest"])
    heads = heads.select(F.col("doc_id").alias("id"), "digest", "sig")
    groups = components(candidates(heads.select("id", "sig"), coords, matches))
    links = confirm(docs, groups.join(heads.select("id", "digest"), "id"), width, percent)
    # A doc_id of several texts stands for all their classes.
    ids = full.select("doc_id", "digest").distinct().join(first, "digest").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = full.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select(F.col("doc_id").alias("a"))
    linked = components(links.unionByName(ids.join(several, "a", "left_semi")))
    named = first.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = every.drop("sig").join(named, "digest", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, that of the smallest doc_id."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id")
    # A null doc_id has no id to be kept by: its rows stay.
    return docs.where("doc_id IS NULL").unionByName(docs.join(kept, "doc_id", "left_semi"))


def sql(docs: str = "documents") -> str:
    return f"""
s7 AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM {docs}
), g7 AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i : i + {WIDTH - 1}], ' '))) END AS g
  FROM s7
), n7 AS (SELECT doc_id, len(g) AS n FROM g7),
e7 AS (SELECT doc_id, unnest(g) AS s FROM g7),
c7 AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e7 a JOIN e7 b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), k7 AS (
  SELECT c7.a, c7.b FROM c7 JOIN n7 x ON x.doc_id = c7.a JOIN n7 y ON y.doc_id = c7.b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)
), r7 AS (
  SELECT doc_id AS a, doc_id AS b FROM n7 UNION SELECT r7.a, k7.b FROM r7 JOIN k7 ON k7.a = r7.b
), op7 AS (
  SELECT n7.doc_id, CAST(n7.n AS BIGINT) AS n_shingles, min(r7.b) AS component_id, min(r7.b) = n7.doc_id AS kept
  FROM n7 JOIN r7 ON r7.a = n7.doc_id GROUP BY n7.doc_id, n7.n
)"""


QUERIES = {"op7_near_dedup": op7_near_dedup}
ORACLES = {"op7_near_dedup": f"WITH RECURSIVE {sql()} SELECT * FROM op7"}
