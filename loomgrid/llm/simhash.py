"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprints are cut into segments, and each segment is read as a word of the binary Golay code (23, 12, 7). That
code is perfect: every word is within three bits of one codeword. The keys of a word are the indices of all
codewords within four bits of it, six at most; two words that differ in at most two bits have one of them in
common, namely the codeword nearest to a word between them. Fingerprints that share a key in both segments of a
pair are candidates: 24 bits of key, at most 36 keys for each pair of segments.

Two rules of linking use this:

* ``RULE_BITS`` (:func:`near_duplicates`): 64 bits over 4-word shingles, linked at 4 or fewer differing bits. There
  are three segments. Of four errors in three segments, more than two can lie in one segment only, so in at least
  two segments two linked fingerprints share a key: the candidates are complete.
* ``RULE_JACCARD`` (:func:`near_dedup`): fingerprints over the set of 5-word shingles. The first 256 bits give six
  pairs of segments of 21 bits; at a Jaccard similarity of 0.8 a segment has three errors on average, a pair of
  segments shares a key in two of five cases, and one of six pairs does in most. Candidates that differ in at most
  56 of the 256 bits are verified by a longer fingerprint of 1,024 bits, whose differing bits tell the similarity
  to some 0.03: they link if these say 0.8 or more.

All this runs on distinct fingerprints, so copies cost nothing. Candidates are verified by their bits where
they meet, and only a spanning forest of the links that a task finds leaves it: no pairs are emitted, and no
link between different fingerprints is lost. A key with more fingerprints than ``block`` is dealt out in
blocks, each pair of which is a piece of work of its own. Components are then joined by label propagation
over tables, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import bound_batches, join_counted, lean, materialize, pin_splits, rest_of, small_or_not

SHINGLE = 4
SEED = 42
MOST_BITS = 4
#: Fingerprints of one key that one task compares; keys with more are dealt out in blocks of this size.
BLOCK = 4096
#: One fingerprint in so many is counted to find the keys that must be dealt out, which changes the work and not the links.
COUNTED = 8
#: Rows of keys that one task gets on average.
KEYS_A_TASK = 600_000
#: Fingerprints whose keys leave a worker in one batch.
KEYED = 512
#: Fixed value: the generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
_GOLAY = 0b110001110101
#: The increment and the multipliers of splitmix64.
_SPLITMIX = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)))
_HASHED = 1 << 16


@dataclass(frozen=True)
class Rule:
    """How texts are fingerprinted and which fingerprints link.

    ``segments`` are (word of 64 bits, first bit, bits), ``pairs`` are the pairs of them that give keys, and ``most``
    is the number of bits in which linked fingerprints may differ. With ``proof``, such links are candidates, and
    fingerprints of ``proof`` times 64 bits must differ in ``proof_most`` bits at most.
    """

    words: int
    shingle: int
    segments: tuple[tuple[int, int, int], ...]
    pairs: tuple[tuple[int, int], ...]
    most: int
    proof: int = 0
    proof_most: int = 0

    @property
    def columns(self) -> list[str]:
        return [f"w{k}" for k in range(self.words)]


RULE_BITS = Rule(1, SHINGLE, ((0, 0, 22), (0, 22, 21), (0, 43, 21)), ((0, 1), (0, 2), (1, 2)), MOST_BITS)
RULE_JACCARD = Rule(4, 5, tuple((w, 21 * k, 21) for w in range(4) for k in range(3)), tuple((k, k + 1) for k in range(0, 12, 2)), 56, 16, 165)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of a text, repeats included.

    A-Z is lower-cased; words are what lies between spaces and the characters 9 to 13. A text with fewer words
    than a shingle is one shingle; a text without words, and null, has none.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends, digest, n = ends.tolist(), xxhash.xxh64_intdigest, len(words) - size + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])), np.uint64, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set in each column of ``hashes`` (rows x words), as words x 64: 255 rows at a time add up in lanes of a byte."""
    rows, words = -(-len(hashes) // 255), hashes.shape[1]
    padded = np.zeros((rows * 255, words), np.uint64)
    padded[: len(hashes)] = hashes
    padded = padded.reshape(rows, 255, words)
    lanes = np.uint64(0x0101010101010101)
    sums = [((padded >> np.uint64(k)) & lanes).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(rows, words, 8).sum(axis=0, dtype=np.int64) for k in range(8)]
    return np.stack(sums, axis=2).reshape(words, 64)


def _spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash (of one column) spread to ``words`` times 64 bits by splitmix64."""
    step, first, second = _SPLITMIX
    h = hashes[:, None] + (step * np.arange(1, words + 1, dtype=np.uint64))[None, :]
    h = (h ^ (h >> np.uint64(30))) * first
    h = (h ^ (h >> np.uint64(27))) * second
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    sums = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), _HASHED):  # bounds the memory of a very long text
        part = hashes[at : at + _HASHED]
        sums += bit_counts(part[:, None] if words == 1 else _spread(part, words))
    return np.packbits(2 * sums > len(hashes), axis=1, bitorder="little").view(np.uint64).reshape(words)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in 64 bits: a bit is set if it's set in over half of the shingles' hashes; 0 without words."""
    return int(_majority(shingle_hashes(text, shingle))[0])


def wide_fingerprint(text: str | None, shingle: int, words: int) -> np.ndarray:
    """The SimHash of the set of shingles of a text in ``words`` (two or more) times 64 bits; zeros without words."""
    return _majority(np.unique(shingle_hashes(text, shingle)), words)


def fingerprints(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, w0, ..., proof) of each row; uid numbers the rows as they are read, w0 and so on hold 64 bits each as signed numbers.

    proof holds the longer fingerprint, whose beginning w0 and so on are; it's null for a rule without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [wide_fingerprint(t, rule.shingle, rule.proof) if rule.proof else [fingerprint(t, rule.shingle)] for t in texts]
            found = np.array(made, np.uint64).reshape(len(texts), max(rule.proof, rule.words))
            proof = pa.array([row.tobytes() if rule.proof else None for row in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k].copy().view(np.int64)) for k in range(rule.words)), proof], ["uid", "doc_id", *rule.columns, "proof"])

    pin_splits(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "simhash"), f"uid bigint, doc_id bigint, {', '.join(f'{c} bigint' for c in rule.columns)}, proof binary")


def _golay_errors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parity of each 12-bit index, errors by syndrome, how many): the words of at most 4 bits with each syndrome that are nearest or within 4 bits."""

    def remainder(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _GOLAY << (k - 11)
        return x

    single = [remainder(1 << k) for k in range(23)]
    found: list[list[int]] = [[] for _ in range(2048)]

    def grow(first: int, word: int, syndrome: int, bits: int) -> None:
        found[syndrome].append(word)
        if bits < 4:
            for k in range(first, 23):
                grow(k + 1, word | 1 << k, syndrome ^ single[k], bits + 1)

    grow(0, 0, 0, 0)
    many = np.array([len(x) for x in found])
    table = np.array([x + [x[0]] * (many.max() - len(x)) for x in found], np.int64)
    parity = np.array([remainder(i << 11) for i in range(4096)], np.int64)
    return parity, table, many


_TABLES: list = []


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (words x 6) of the codewords within four bits of each 23-bit word, and which of them count."""
    if not _TABLES:
        _TABLES.extend(_golay_errors())
    parity, errors, many = _TABLES
    syndrome = parity[words >> 11] ^ (words & 0x7FF)
    index = (words[:, None] ^ errors[syndrome]) >> 11
    return index, np.arange(errors.shape[1])[None, :] < many[syndrome][:, None]


def pair_keys(fps: np.ndarray, rule: Rule = RULE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(key, row of ``fps``) of all keys: a pair of segments and a codeword index in each. ``fps`` has a column for each 64 bits."""
    bits = fps.reshape(len(fps), rule.words).view(np.uint64)
    parts = [segment_keys(((bits[:, w] >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for w, at, n in rule.segments]
    keys, owners = [], []
    for number, (i, j) in enumerate(rule.pairs):
        (a, good_a), (b, good_b) = parts[i], parts[j]
        key = (np.int64(number) << 24) | (a[:, :, None] << 12) | b[:, None, :]
        good = good_a[:, :, None] & good_b[:, None, :]
        keys.append(key[good])
        owners.append(np.broadcast_to(np.arange(len(fps))[:, None, None], key.shape)[good])
    return np.concatenate(keys), np.concatenate(owners)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for the links a-b among nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def _apart(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """In how many bits rows of a and b (a column for each 64 bits) differ; those that differ in more than ``most`` leave early, with any number above."""
    apart = np.bitwise_count(a[:, 0] ^ b[:, 0]).astype(np.int64)
    for k in range(1, a.shape[1]):
        open_ = np.flatnonzero(apart <= most)
        apart[open_] += np.bitwise_count(a[open_, k] ^ b[open_, k])
    return apart


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links a-b among nodes 0 to n - 1 that a spanning forest of the nearest ones has: each component takes its nearest link out, until none has any."""
    order = np.lexsort((b, a, apart))
    a, b, apart = a[order], b[order], apart[order]
    root, taken, left = np.arange(n), [], np.arange(len(a))
    while len(left := left[root[a[left]] != root[b[left]]]):
        best = np.full(n, len(a))
        np.minimum.at(best, root[a[left]], left)
        np.minimum.at(best, root[b[left]], left)
        taken.append(np.unique(best[best < len(a)]))
        root = _roots(root[a[taken[-1]]], root[b[taken[-1]]], n)[root]
    kept = np.concatenate(taken) if taken else np.zeros(0, np.int64)
    return a[kept], b[kept], apart[kept]


def bucket_links(group: np.ndarray, side: np.ndarray, node: np.ndarray, fps: np.ndarray, most: int = MOST_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the groups, of the nearest pairs of nodes.

    Each row of ``fps`` belongs to the node of the same place. side: 0 and 1 are compared with one another only, 2 with all of its group.
    """
    order = np.lexsort((node, group))
    group, side, fps = group[order], side[order], fps.reshape(len(order), -1).view(np.uint64)
    values, node = np.unique(node[order], return_inverse=True)
    held, found, many = (np.zeros(0, np.int64),) * 3, [], 0
    active, step = np.arange(len(group)), 1
    while len(active):
        active = active[active + step < len(group)]
        active = active[group[active] == group[active + step]]
        for at in range(0, len(active), 1 << 18):  # bounds the rows that are laid side by side
            here = active[at : at + (1 << 18)]
            here = here[(side[here] == 2) | (side[here] != side[here + step])]
            apart = _apart(fps[order[here]], fps[order[here + step]], most)
            near = here[apart <= most]
            if len(near):
                found.append((node[near], node[near + step], apart[apart <= most]))
                many += len(near)
        step += 1
        if found and (not len(active) or many > 1 << 20):
            held, found, many = _forest(*(np.concatenate([h, *f]) for h, *f in zip(held, *found)), len(values)), [], 0
    return values[held[0]], values[held[1]]


def _links(fps: DataFrame, block: int, rule: Rule) -> DataFrame:
    """(a, b) of linked nodes, so that a and b are in one component exactly if a path of links leads from one to the other."""
    carried = ", ".join(f"{c} bigint" for c in ["node", *rule.columns])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, KEYED):
                part = pa.RecordBatch.from_arrays([c[at : at + KEYED] for c in batch.columns], batch.schema.names)
                key, owner = pair_keys(np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1), rule)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(c.take(pa.array(owner)) for c in part.columns)], ["key", *part.schema.names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            fps_of = np.empty((table.num_rows, rule.words), np.int64)
            for k, c in enumerate(rule.columns):
                fps_of[:, k] = table.column(c).to_numpy()
            columns = {name: table.column(name).to_numpy() for name in table.column_names if name not in rule.columns}
            del batches, table  # the rows lie here once from now on
            group, side = columns["key"], columns.get("side", np.full(len(fps_of), 2, np.int8))
            if "low" in columns:
                group = np.unique(np.stack([columns[c].astype(np.int64) for c in ("key", "low", "high")]), axis=1, return_inverse=True)[1].reshape(-1)
            a, b = bucket_links(group, side, columns["node"], fps_of, rule.most)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    # each fingerprint becomes some 28 rows for each pair of segments, so the small table is dealt out before it grows
    own = fps.select("node", *rule.columns)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-own.count() * 28 * len(rule.pairs) // KEYS_A_TASK))
    dealt_out = own.repartition(parts, "node")
    rows = dealt_out.mapInArrow(lean(keyed, "simhash"), f"key int, {carried}")
    counted = dealt_out.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).mapInArrow(lean(keyed, "simhash"), f"key int, {carried}")
    hot = materialize(counted.groupBy("key").agg((F.count(F.lit(1)) * COUNTED).alias("n")).where(F.col("n") > block // 2), "hot-keys")
    if hot.isEmpty():
        return rows.repartition(parts, "key").mapInArrow(lean(compared, "simhash"), "a bigint, b bigint")
    hot = small_or_not(hot)
    cold = rows.join(hot, "key", "left_anti").repartition(parts, "key").mapInArrow(lean(compared, "simhash"), "a bigint, b bigint")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    dealt = rows.join(hot, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = dealt.select("key", "own", "node", *rule.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("byte")
    work = paired.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), side.alias("side"), "node", *rule.columns)
    return cold.unionByName(work.repartition(parts, "key", "low", "high").mapInArrow(lean(compared, "simhash"), "a bigint, b bigint"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of each node of ``links`` (a, b): the least node of its component.

    Large-star and small-star steps by turns; every step's table lies in the shared scratch folder. The root of a
    large component has most of its links, so a frequent node's least neighbour is broadcast to its links.
    """

    def leasts(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(leasts(both).select("u", F.least("u", "m").alias("m"), "n"), "leasts")
        large = materialize(join_counted(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct(), "large-star")
        least = materialize(leasts(large), "leasts")
        small = join_counted(large, least, "u")
        new = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(new, "links")
        # a forest of stars: each node has one link, and no node that others link to has one itself
        twice = new.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        inner = new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi")
        if twice.isEmpty() and inner.isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges = new


def _proven(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """The candidates whose long fingerprints differ in at most ``most`` bits. A node has 128 bytes, however long its text is."""

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (2, 3))
            near = pa.array(np.bitwise_count(x ^ y).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    for side in ("a", "b"):
        counts = pairs.groupBy(F.col(side).alias("node")).agg(F.count(F.lit(1)).alias("n"))
        proofs = materialize(distinct.select("node", "proof").join(counts, "node").select(F.col("node").alias(side), F.col("proof").alias(f"proof_{side}"), "n"), "proofs")
        pairs = join_counted(pairs, proofs, side)
    return pairs.select("a", "b", "proof_a", "proof_b").mapInArrow(lean(verified, "simhash"), "a bigint, b bigint")


def _labelled(docs: DataFrame, id_col: str, text_col: str, block: int, rule: Rule) -> DataFrame:
    """(uid, doc_id, w0, ..., component_id, first_uid) of each row of ``docs``; first_uid is the least uid of the component."""
    rows = materialize(fingerprints(docs, rule, id_col, text_col), "fingerprints")
    distinct = rows.groupBy(*rule.columns).agg(F.min("doc_id").alias("least"), F.min("uid").alias("node"), F.count(F.lit(1)).alias("n"), F.min("proof").alias("proof"))
    distinct = materialize(distinct, "distinct-fingerprints")
    links = _links(distinct, block, rule)
    joined = materialize(components(_proven(links, distinct, rule.proof_most) if rule.proof else links), "components")
    rooted = materialize(distinct.drop("proof").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    named = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("node").alias("first_uid"), F.count(F.lit(1)).alias("n")), "roots")
    labels = join_counted(rooted.select(*rule.columns, "root", F.col("n").alias("copies")), named, "root").select(*rule.columns, "component_id", "first_uid", F.col("copies").alias("n"))
    return join_counted(rows.drop("proof"), materialize(labels, "labels"), *rule.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs``, by ``RULE_BITS``.

    component_id is the smallest id that a path of links reaches, the row's own included; a null id counts
    as larger than all others. Null and empty texts have fingerprint zero and link like any other. Repeated rows
    are one component and give a row each. An empty table gives no rows. Other columns aren't read.
    """
    return _labelled(docs, id_col, text_col, block, RULE_BITS).select("doc_id", F.lpad(F.lower(F.hex("w0")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, rule: Rule = RULE_JACCARD) -> DataFrame:
    """One row of ``docs`` for each component by ``rule``, the one with the smallest id, with all columns.

    Of rows of the component that repeat that id, and of a component of null ids only, the first that is read
    stays. What a row's id does in other components doesn't matter. Null and empty texts are one component.
    An empty table gives no rows.

    ``docs`` is read a second time, so it must be a table whose rows come in the same order each time, such
    as a Parquet folder. The numbers of the dropped rows are broadcast if there are few of them.
    """
    own = "__lg_uid"
    groups = materialize(_labelled(docs, id_col, text_col, block, rule).select("uid", "doc_id", "component_id", "first_uid"), "near-groups")
    # the first row that has the smallest id of its component; of null ids only, the component's first row
    heads = groups.where("doc_id = component_id or (component_id is null and uid = first_uid)").groupBy("first_uid").agg(F.min("uid").alias("head"))
    dropped = groups.select("uid").join(heads.select(F.col("head").alias("uid")), "uid", "left_anti").select(F.col("uid").alias(own))
    dropped = materialize(dropped, "dropped")
    return docs.withColumn(own, F.monotonically_increasing_id()).join(small_or_not(dropped, 2_000_000), own, "left_anti").select(*rest_of(docs, own))
