"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, id_and_text, new_folder, pieces, staged

#: Shingles hashed at once in a task.
STEP = 100_000


def shingle_hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, repeats included, ``STEP`` at a time.

    A-Z are lower-cased, words are what ASCII white space leaves; with fewer words than ``shingle`` the whole sequence
    is the one shingle; without words there is none.
    """
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    for at in range(0, n, STEP):
        part = words[at : min(n, at + STEP) + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        yield np.array([xxh64_intdigest(b" ".join(r), 42) for r in rows], "<u8")


def simhash64(hashes: Iterable[np.ndarray]) -> int:
    """SimHash of shingle hashes as an unsigned number: a bit is 1 if set in over half of them; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash as a signed long of every row; a null text counts as empty."""
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fps = np.array([simhash64(shingle_hashes(x.as_py(), shingle)) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """Array of keys, one for each choice of ``blocks - distance`` blocks: a close pair differs in at most ``distance`` blocks, so shares one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which of b lie within ``distance`` bits of any of a."""
    found = np.zeros(len(b), bool)
    step = max(1, 4_000_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        found |= (np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= distance).any(0)
    return found


def spanning_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (member, smallest) that join exactly what chains of close pairs join within ``fps``."""
    left, out = np.sort(fps), []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = near(front.view(np.uint64), left.view(np.uint64), distance)
            front, left = left[hit], left[~hit]
            out += [(int(x), int(root)) for x in front]
    return out


def links(fps: DataFrame, distance: int, blocks: int, bucket: int) -> DataFrame:
    """(a, b): links between different fingerprints that span every chain of pairs within ``distance`` bits.

    Fingerprints are dealt by block key; keys of one fingerprint are left out. A key's fingerprints are compared in one
    task by vectorised breadth-first search, which gives fewer links than members. A key with more than ``bucket`` of
    them is split into parts, and every two parts are compared by a task of their own, so no task grows with a key.
    """
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key")).select("fp", "key.k", "key.bits")
    counts = keyed.groupBy("k", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    many = keyed.join(counts, ["k", "bits"]).withColumn("parts", F.ceil(F.col("n") / bucket).cast("int"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, part).alias("i"), F.greatest(q, part).alias("j"))))
    dealt = many.select("fp", "k", "bits", F.explode(pairs).alias("p")).select("fp", "k", "bits", "p.i", "p.j")
    dealt = dealt.repartition("k", "bits", "i", "j").sortWithinPartitions("k", "bits", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last key's rows, which may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]) if rest is not None else rows
            cols = [rows.column(c).to_numpy() for c in ("fp", "k", "bits", "i", "j")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[1:]], axis=0)) + 1
            done = change[-1] if len(change) else 0
            rest = rows.slice(done)
            yield from found(cols[0], [0, *change.tolist()])
        if rest is not None:
            yield from found(rest.column("fp").to_numpy(), [0, rest.num_rows])

    def found(fp: np.ndarray, edges: list[int]) -> Iterator[pa.RecordBatch]:
        out = [x for s, e in zip(edges, edges[1:]) if e > s + 1 for x in spanning_links(fp[s:e], distance)]
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars.

    Every round is written to the shared folder, and the round before it deleted; only a sum per round reaches the driver.
    """
    spark, path = edges.sparkSession, new_folder(edges.sparkSession, "edges")
    pairs = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", path)
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        old, path = path, new_folder(spark, "edges")
        pairs = staged(small.filter("u <> v").distinct(), "edges", path)
        delete(spark, old)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 3,
                    blocks: int = 6) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    component_id is the smallest doc_id reachable over links of at most ``distance`` differing bits, null only where no
    row of the component has an id. Texts without words have fingerprint zero and link like any other; a null text is
    empty; repeated rows are returned as often as they come; an empty table gives no rows; other columns are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    roots = components(links(prints.select("fp").distinct(), distance, blocks, 20_000)).withColumnRenamed("node", "fp")
    per_print = prints.groupBy("fp").agg(F.min("doc_id").alias("low")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_print = staged(per_print, "prints-root")
    lows = per_print.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(per_print.join(lows, "root").select("fp", "component_id"), "prints-component")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def multipliers(n: int, seed: int = 17) -> np.ndarray:
    """``n`` odd 64-bit numbers; the product with one of them, cut to 64 bits, reorders hashes at random."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Keys of a set of hashes, one for each band of ``rows`` least hashes in as many random orders.

    Two sets of Jaccard index s share a key of a band with probability s ** rows: of 45 bands of 6 rows a pair at 0.8 shares none
    once in 900,000, a pair at 0.1 shares one once in 22,000.
    """
    a = multipliers(rows * bands)
    least = np.full(rows * bands, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 2048):
        x = h[at : at + 2048, None] * a
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(0), out=least)
    band = least.reshape(bands, rows) * multipliers(rows, 18)
    return band.sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def content_of(every: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """(content, sorted set of hashes) of a text's ``shingle_hashes``; content, a signed long, is a hash of the set, 0 without words."""
    from xxhash import xxh64_intdigest

    if not every:
        return 0, np.zeros(0, np.uint64)
    h = np.unique(np.concatenate(every))
    return int(np.uint64(xxh64_intdigest(h.tobytes(), 1)).astype(np.int64)), h


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (member, first) by place that join exactly what chains of pairs of at least that Jaccard index join.

    Breadth-first search; a set meets those not yet reached that share one of its rarest hashes, as many as leave less than an overlap
    behind, and is compared with each in whole. The index of those hashes is made anew whenever half of its sets are reached.
    """
    size = np.array([len(x) for x in sets])
    end = np.cumsum(size)
    start, owner = end - size, np.repeat(np.arange(len(sets)), size)
    _, ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = ids[np.lexsort((ids, times[ids], owner))]  # of each set, the rarest first
    prefix = size - np.ceil(similarity * size - 1e-9).astype(int) + 1
    indexed = np.flatnonzero(np.arange(len(ids)) - start[owner] < prefix[owner])
    indexed = indexed[np.argsort(ids[indexed], kind="stable")]
    left, marked, out = np.ones(len(sets), bool), np.zeros(len(times), bool), []
    at = np.searchsorted(ids[indexed], np.arange(len(times) + 1))
    remain = built = len(sets)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], front = False, [root]
        remain -= 1
        while front and remain:
            if 2 * remain < built:
                indexed, built = indexed[left[owner[indexed]]], remain
                at = np.searchsorted(ids[indexed], np.arange(len(times) + 1))
            one = front.pop()
            mine = ids[start[one] : end[one]]
            lists = [indexed[at[i] : at[i + 1]] for i in mine[: prefix[one]]]
            met = np.unique(owner[np.concatenate(lists)])
            met = met[left[met]]
            met = met[np.minimum(size[met], size[one]) >= similarity * np.maximum(size[met], size[one]) - 1e-9]
            if not len(met):
                continue
            marked[mine] = True
            common = np.array([np.count_nonzero(marked[ids[start[m] : end[m]]]) for m in met])
            marked[mine] = False
            hit = met[common / (size[met] + size[one] - common) >= similarity]
            left[hit] = False
            remain -= len(hit)
            front += hit.tolist()
            out += [(m, root) for m in hit.tolist()]
    return out


def group_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """(a, b): ``set_links`` between the contents of each (g, i, j) of ``dealt`` (g, i, j, c, s), each in one task."""
    key = ["g", "i", "j"]
    rows = dealt.select(*key, "c", "s").repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            for at, c, s in zip(place, batch.column(3).to_pylist(), batch.column(4)):
                if at != of:
                    yield from found(held)
                    held, of = [], at
                held.append((c, s.values.to_numpy().view(np.uint64).copy()))  # a copy, so that the batch can go
        yield from found(held)

    def found(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        out = set_links([s for _, s in held], similarity) if len(held) > 1 else []
        if out:
            a, b = zip(*((held[x][0], held[y][0]) for x, y in out))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def content_filter(contents: DataFrame, bits: int) -> np.ndarray:
    """Bits at the contents' places (their lowest bits); ``bits`` / 64 words at most reach the driver."""
    place = contents.select(F.col("c").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = place.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    out, got = np.zeros(bits // 64, np.uint64), words.toArrow()
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def leader_links(keys: DataFrame, sets: DataFrame, similarity: float, bands: int) -> DataFrame:
    """(a, b): the contents of ``keys`` (c, n, band, low, low_n) that have at least that Jaccard index with the first content of their key, in the first ``bands`` bands.

    Every pair is compared once, by ``sets`` (c, s). A hot first content is the hot key of one join, which AQE splits.
    """
    near = F.least("n", "low_n") >= similarity * F.greatest("n", "low_n") - 1e-9
    pairs = keys.filter((F.col("band") < bands) & (F.col("c") != F.col("low"))).filter(near).select("c", "n", "low", "low_n").distinct()
    both = pairs.join(sets, "c").join(sets.select(F.col("c").alias("low"), F.col("s").alias("t")), "low")
    common = F.size(F.array_intersect("s", "t"))
    return both.filter(common / (F.col("n") + F.col("low_n") - common) >= similarity).select(F.col("c").alias("a"), F.col("low").alias("b"))


def open_keys(keys: DataFrame, roots: DataFrame, part: int) -> DataFrame:
    """(g, c, parts): the members of keys that ``roots`` (node, root) leaves in more than one piece; of keys with the same members one."""
    rows = keys.select("key", "c", "n").distinct().join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    members = [F.count("*").alias("of"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(2))).alias("y")]
    sized = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("n"), *members).filter("low < high")
    once = sized.groupBy("of", "x", "y").agg(F.min("key").alias("key"), F.min("n").alias("n"))
    return rows.select("key", "c").join(once.select("key", F.ceil(F.col("n") / part).cast("int").alias("parts")), "key").withColumnRenamed("key", "g")


def print_keys(found: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(c, n, band, key) of ``found`` (c, n, fp): equal keys, in band -1, for contents whose SimHashes are joined by chains of at most ``distance`` bits."""
    prints = found.filter("n > 0").select("c", "n", "fp").distinct()
    roots = components(links(prints.select("fp").distinct(), distance, blocks, 20_000)).withColumnRenamed("node", "fp")
    key = F.xxhash64(F.coalesce("root", "fp"), F.lit("simhash"))
    return prints.join(roots, "fp", "left").select("c", "n", F.lit(-1).alias("band"), key.alias("key"))


def copy_roots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
               rows: int = 6, bands: int = 45, part: int = 1_000_000, bits: int = 1 << 25, leaders: int = 5, distance: int = 3,
               blocks: int = 6) -> tuple[DataFrame, DataFrame]:
    """(doc_id, c) of every row, c its content, and (c, root): equal roots for contents joined by chains of pairs whose shingle
    sets have at least that Jaccard index. Contents like no other have no root.

    Candidates are contents that share a key: first those whose 64-bit SimHashes chains of ``distance`` bits join (``links`` and ``components``, as in
    ``near_duplicates``), then, as at an index of 0.8 about ten of its bits differ, those that share a key of ``bands`` (``band_keys``). Among
    contents alike by SimHash and in the first ``leaders`` bands the contents of a key are compared with its first one
    (``leader_links``), which joins most near copies in time linear in their number. Keys whose contents are still in more than one piece
    then have all their contents compared by whole sets (``set_links``), each key in one task; a key of more than ``part`` shingles is split into parts, and
    every two parts are compared by a task of their own. Only compared pairs join contents: keys shared by chance join nothing. Sets are shuffled only
    if a filter of ``bits``, which knows the contents with shared keys, lets them through. Texts with equal sets are one node; texts
    without words are alike.
    """
    texts = id_and_text(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # keys of equal contents leave a task once
        for b in pieces(batches):
            cs, ns, keys, fps = [], [], [], []
            for x in b.column(1):
                every = list(shingle_hashes(x.as_py(), shingle))
                c, h = content_of(every)
                keys.append(None if c in seen or not len(h) else band_keys(h, rows, bands).view(np.int64))
                cs.append(c)
                ns.append(len(h))
                fps.append(simhash64(every))
                seen.add(c)
            columns = [pa.array(cs, pa.int64()), pa.array(ns, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "c", "n", "keys", "fp"])

    spark = docs.sparkSession
    key_path, set_path = new_folder(spark, "near-keys"), new_folder(spark, "near-sets")
    found = staged(texts.mapInArrow(prints, f"doc_id {kind}, c long, n long, keys array<long>, fp long"), "prints")
    keyed = found.select("c", "n", F.posexplode("keys").alias("band", "key")).unionByName(print_keys(found, distance, blocks))
    shared = keyed.groupBy("key").agg(F.min(F.struct("c", "n")).alias("low"), F.max("c").alias("high")).filter("low.c < high")
    keys = staged(keyed.join(shared.select("key", F.col("low.c").alias("low"), F.col("low.n").alias("low_n")), "key"), "near-keys", key_path)
    members = keys.select("c").distinct()
    mask = spark.sparkContext.broadcast(content_filter(members, bits).tobytes())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen = np.frombuffer(mask.value, np.uint64), set()
        for b in pieces(batches):
            cs, ss = [], []
            for x in b.column(0):
                c, h = content_of(list(shingle_hashes(x.as_py(), shingle)))
                at = c & (bits - 1)
                if c not in seen and len(h) and int(asked[at >> 6]) >> (at & 63) & 1:
                    seen.add(c)
                    cs.append(c)
                    ss.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ss, pa.list_(pa.int64()))], ["c", "s"])

    sets = texts.select("text").mapInArrow(whole, "c long, s array<long>").groupBy("c").agg(F.first("s").alias("s"))
    sets = staged(sets.join(members, "c", "left_semi"), "near-sets", set_path)
    joined = components(leader_links(keys, sets, similarity, leaders))
    compared = open_keys(keys, joined, part).join(sets, "c")
    mine = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, mine).alias("i"), F.greatest(q, mine).alias("j")))
    dealt = compared.select("g", "c", "s", F.explode(pairs).alias("p")).select("g", "p.i", "p.j", "c", "s")
    roots = components(group_links(dealt, similarity).union(joined.select("node", "root"))).withColumnRenamed("node", "c")
    delete(spark, key_path)
    delete(spark, set_path)
    return found.select("doc_id", "c"), roots


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, content, root of every row: equal roots for the texts that ``copy_roots`` joins."""
    found, roots = copy_roots(docs, id_col, text_col, **options)
    return found.join(roots, "c", "left").select("doc_id", F.col("c").alias("content"), F.coalesce("root", "c").alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of ``near_copies``: that of the smallest id (null ids last).

    Rows that agree in every column count as one. The columns are those of ``docs``, of any name; a null text is an empty one; an empty table
    gives no rows. Texts are read whole, however long.
    """
    marked = [x for c in docs.columns for x in (F.col(f"`{c}`").cast("string"), F.col(f"`{c}`").isNull())]  # hashes skip nulls
    key = F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *marked).alias("b"))
    keyed = docs.select(key.alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    rows = keyed.select(F.struct(F.col("id").isNull().alias("none"), "id", "row").alias("doc_id"), "text")
    found, roots = copy_roots(rows, "doc_id", "text", **options)
    first = found.groupBy("c").agg(F.min("doc_id").alias("doc_id")).join(roots, "c", "left")
    first = first.groupBy(F.coalesce("root", "c").alias("root")).agg(F.min("doc_id").alias("doc_id")).select(F.col("doc_id.row").alias("row"))
    kept = keyed.select("row", "doc").join(first, "row", "left_semi").dropDuplicates(["row"])  # one shuffle by row serves both
    return kept.select("doc.*")
