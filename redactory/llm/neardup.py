"""Near-duplicates: MinHash bands, odd-sketch estimates, links confirmed on whole shingle sets.

1. Each document's shingle set gives MinHash samples; bands of four make
   bucket keys, and all samples are folded into one odd sketch.
2. Equal sets collapse to one node.
3. Sets that share a bucket are candidates. In a small bucket all pairs are; in a
   large one each set is compared with the bucket's hub (the set that is in most
   company over all its buckets). Sketches drop candidates that are far apart.
4. A first round confirms each set's best candidate and hub; confirmed links are
   contracted to components, and from then on only sets of different components meet.
5. Sets of large buckets that still hold several components meet at shingles instead,
   ranked by rarity: two near sets share one early enough in both to leave room for
   the overlap asked. The sets of a shingle are gone through hub by hub, many times as
   many in each round, until every pair has met or its components have joined.

No step makes more rows than its members times the hubs of a round; every join by a
bucket, shingle or hub is split by its size; nothing is dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import FEW_ROWS, HOT_SHARE, attach, in_worker, materialise, per_batch, texts_of
from redactory.llm.components import components

BANDS, ROWS, SAMPLES, SKETCH_BITS = 20, 4, 128, 512
#: Buckets up to this many sets are compared pair by pair.
SMALL_BUCKET = 32
#: Most pairs that are sent to all tasks when they are confirmed.
FEW_PAIRS = 20_000
#: Rows of one bucket or hub that one task's share of a join should hold.
SHARE_ROWS = 256
#: Counters of how common shingles are (a power of two), and by how much the hubs of a round outnumber those before.
COUNTERS, GROWTH = 1 << 18, 16
#: Candidates are dropped below an estimate this far under the threshold.
MARGIN = 0.2
_CACHE_WORDS = 150_000
_rng = np.random.Generator(np.random.PCG64(20240607))
_MUL = (_rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_XOR = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, SAMPLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class ShingleSets:
    """text -> sorted 64-bit hashes of its distinct word shingles."""

    def __init__(self, width: int):
        self.width = width

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = out = xxhash.xxh3_64_intdigest(word)
                return out

        self.words = Words()

    def __call__(self, text: str) -> np.ndarray:
        if len(self.words) > _CACHE_WORDS:
            self.words.clear()
        words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII separators
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash samples of a non-empty set, over slices so that long sets stay small in memory."""
    out = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, ((s[None, at : at + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return out


def bands_of(m: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS samples; a band's number is part of its key."""
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys + m[r : BANDS * ROWS : ROWS])
    return keys


def odd_sketch(m: np.ndarray) -> np.ndarray:
    """Parities of the samples' places in SKETCH_BITS bits."""
    places = (_mix(m + _mix(np.arange(SAMPLES, dtype=np.uint64))) >> np.uint64(55)).astype(np.int64)
    return (np.bincount(places, minlength=SKETCH_BITS) & 1).astype(np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text: rows of one doc_id and text have one key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key("text").alias("text_key"), "text")


def text_key(column: str) -> Column:
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n, digest, bands (array of long), sketch (array of 8 longs); no digest where the set is empty."""

    def setup():
        sets = in_worker(("shingles", width), lambda: ShingleSets(width))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in texts_of(batch):
                s = sets(text)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                m = signature(s)
                rows.append((len(s), digest_of(s), bands_of(m).view(np.int64), np.packbits(odd_sketch(m)).view(np.int64)))
            n, digest, bands, sketch = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "digest", "bands", "sketch"])

        return step

    return per_batch(_keyed(docs), setup, "doc_id long, text_key binary, n long, digest binary, bands array<long>, sketch array<long>")


def whole_sets(docs: DataFrame, width: int) -> DataFrame:
    """digest, items: the sorted shingle set of each row of doc_id, text_key, text."""

    def setup():
        sets = in_worker(("shingles", width), lambda: ShingleSets(width))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sets(t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([pa.array([digest_of(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], ["digest", "items"])

        return step

    return per_batch(docs.select("text"), setup, "digest binary, items array<long>")


def _differ(a: str, b: str) -> Column:
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def most_bits(percent: int) -> float:
    """Bits in which the sketches of sets at the threshold, less the margin, differ on average."""
    return float(SKETCH_BITS / 2 * (1 - np.exp((percent / 100 - MARGIN - 1) * 4 * SAMPLES / SKETCH_BITS)))


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two sketched sets may reach the threshold: by their sizes and by the odd sketch's estimate."""
    sizes = F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    return sizes & (_differ(a, b) <= most_bits(percent))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """Inner join of rows to groups, each key split over its shares.

    Both sides have sets, the number of rows that a key has; rows has salt, a whole
    number that differs among them; groups has few rows for a key.
    """
    shares = (F.col("sets") / SHARE_ROWS).cast("long") + 1
    left = rows.withColumn("_share", F.pmod(F.xxhash64(salt), shares))
    right = groups.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1))).drop("sets")
    return left.join(right, [*keys, "_share"]).drop("_share")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose whole sets (id, items) reach 100 * intersection >= percent * union.

    A set that is the second of many pairs (a hub) is sent to as many shares as these
    fill. pairs must be stored; up to FEW_PAIRS of them (16 bytes each) go to the sets instead.
    """
    x, y = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    if pairs.count() <= FEW_PAIRS:
        joined = x.join(F.broadcast(pairs), "a").join(y.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi"), "b")
    else:
        many = materialise(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("sets")), "hub-sizes")
        joined = spread_join(attach(pairs, many, ["b"], "sets").join(x, "a"), y.join(many, "b"), ["b"], "a")

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    return per_batch(joined.select("a", "b", "x", "y"), setup, "a long, b long")


class Links:
    """Components of the links confirmed so far; each round's new links are contracted to components first."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.label: DataFrame | None = None

    def component(self, rows: DataFrame, column: str = "id", out: str = "component") -> DataFrame:
        """Adds the component of a column of nodes; a node without a link is its own."""
        if self.label is None:
            return rows.withColumn(out, F.col(column))
        known = self.label.select(F.col("node").alias(column), F.col("component").alias("_c"))
        return rows.join(known, column, "left").withColumn(out, F.coalesce("_c", column)).drop("_c")

    def add(self, links: DataFrame) -> bool:
        """Take links (a, b) as confirmed; whether they join anything."""
        between = self.component(self.component(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
        between = materialise(between.distinct(), "links")
        if between.isEmpty():
            return False
        joined = materialise(components(between), "joined")
        if self.label is None:
            self.label = joined
            return True
        moved = joined.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        old = self.label.join(moved, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        fresh = joined.join(self.label.select("node"), "node", "left_anti")
        self.label = materialise(old.unionByName(fresh), "label")
        return True

    def confirm(self, pairs: DataFrame) -> bool:
        """Confirm candidates (a, b) on whole sets and take the links; whether they join anything."""
        pairs = materialise(pairs.select("a", "b").distinct(), "pairs")
        return not pairs.isEmpty() and self.add(confirm(pairs, self.sets, self.percent))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those between components."""
        return self.component(self.component(pairs, "a", "_ca"), "b", "_cb").where("_ca <> _cb").drop("_ca", "_cb")

    def divided(self, members: DataFrame) -> DataFrame:
        """Members (key, id) of the keys that hold several components, with component."""
        own = self.component(members)
        several = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("sets")).where("lo < hi").select("key", "sets")
        return attach(own.drop("sets"), materialise(several, "divided"), ["key"], "sets")


def _members(keys: DataFrame, nodes: DataFrame, tag: str) -> DataFrame:
    """Rows (key, id) of the keys that several sets have, with sets, n and sketch."""
    buckets = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), f"{tag}-buckets")
    total = buckets.agg(F.sum("sets")).first()[0] or 0
    hot = [r["key"] for r in buckets.where(F.col("sets") >= max(2, int(total * HOT_SHARE))).select("key").collect()]  # at most 1 / HOT_SHARE
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    sized = keys.where(is_hot).join(F.broadcast(buckets.where(is_hot)), "key").unionByName(keys.where(~is_hot).join(buckets.where(~is_hot), "key"))
    return materialise(sized.join(nodes.select("id", "n", "sketch"), "id"), tag)


def _all_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, differ) of near sets that share a small bucket."""
    small = members.where(F.col("sets") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _near("x", "y", percent))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), _differ("x", "y").alias("differ")).distinct()


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, company) of a near set and the hub of a large bucket that they share."""
    company = members.groupBy("id").agg(F.sum("sets").alias("company"))
    large = members.where(F.col("sets") > SMALL_BUCKET).join(company, "id")
    hubs = large.groupBy("key", "sets").agg(F.max(F.struct("company", "id", "n", "sketch")).alias("h")).select("key", "sets", F.col("h.id").alias("hub"), F.struct("h.n", "h.sketch").alias("y"), F.col("h.company").alias("hub_company"))
    met = spread_join(large.select("key", "sets", "id", F.struct("n", "sketch").alias("x")), hubs, ["key"], "id")
    return met.where((F.col("id") != F.col("hub")) & _near("x", "y", percent)).select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("hub_company").alias("company"))


def rarity(sets: DataFrame) -> np.ndarray:
    """How often shingles of sets (items) fall into each of COUNTERS counters: a table of fixed size."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            flat = batch.column("items").flatten().to_numpy(zero_copy_only=False)
            total += np.bincount(flat & (COUNTERS - 1), minlength=COUNTERS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["place", "n"])

    out = np.zeros(COUNTERS, np.int64)
    for r in sets.select("items").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # at most COUNTERS rows
        out[r["place"]] = r["n"]
    return out


def early_items(sets: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """Rows (id, n, early): the shingles of sets (id, items) at which a near set may first be met, in order.

    Shingles are ranked from rare to common, by their counter and then by value, alike
    in all sets. If two sets reach the threshold, their first common shingle leaves,
    in both, enough shingles behind it for the overlap that the threshold asks of
    their sizes; what comes later in a set is left out.
    """

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, early = [], []
            for items in batch.column("items"):
                x = items.values.to_numpy()
                sizes.append(len(x))
                early.append(x[np.lexsort((x, counts[x & (COUNTERS - 1)]))][: (len(x) * (100 - percent) + 100) // 100])
            return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(early, pa.list_(pa.int64()))], ["id", "n", "early"])

        return step

    return per_batch(sets.select("id", "items"), setup, "id long, n long, early array<long>")


def _roomy(percent: int) -> Column:
    """Whether two sets x and y that meet at one shingle have room for the overlap behind it."""
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) + 1
    return room * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent


def hub_rounds(sets: DataFrame, links: Links) -> None:
    """Compare the sets (id, n, early, sketch) of each early shingle with hub after hub while it holds several components.

    The first hub is the set that has fewest shingles before it. Then each set has a
    fixed random place below the number of the shingle's sets, and a round takes the
    places from where the last one ended, GROWTH times as many, as hubs of all sets
    beyond them. So every pair meets, unless its components have joined before.
    """
    first, last, open_, beyond = -1, 1, _open(sets, links), F.lit(True)
    hubs = open_.groupBy("key", "sets").agg(F.min(F.struct("y.at", "y")).alias("h")).select("key", "sets", "h.y")
    while not open_.isEmpty():
        met = spread_join(open_.select("key", "sets", "y.id", F.col("y").alias("x")), hubs, ["key"], "id")
        near = met.where(beyond & (F.col("x.component") != F.col("y.component")) & _near("x", "y", links.percent) & _roomy(links.percent))
        if links.confirm(near.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))):
            open_ = _open(sets, links)
        open_ = open_.where(F.col("y.place") >= first)
        hubs = open_.where(F.col("y.place") < last).select("key", "sets", "y")
        first, last, beyond = last, GROWTH * last + 1, F.col("x.place") > F.col("y.place")


def _open(sets: DataFrame, links: Links) -> DataFrame:
    """Rows (key, sets, y) of the shingles that hold several components: y is one of the key's sets, with all that a comparison reads.

    A place is below 0 where the shingle has few sets: these all are hubs of the second round.
    """
    own = links.component(sets).select("id", "n", "sketch", "component", F.posexplode("early").alias("at", "key"))
    several = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("sets")).where("lo < hi").select("key", "sets")
    place = F.pmod(F.xxhash64("key", "id"), F.lit(1 << 40)) / float(1 << 40)
    place = F.when(F.col("sets") <= SMALL_BUCKET, place - 1).otherwise(place * F.col("sets"))
    return materialise(own.join(several, "key").select("key", "sets", F.struct("id", "n", (F.col("at") + 1).alias("at"), "sketch", place.alias("place"), "component").alias("y")), "open")


def _shared_ids(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of rows that share a doc_id."""
    own = marked.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "digest")
    twice = materialise(own.groupBy("doc_id").agg(F.min("digest").alias("b"), F.max("digest").alias("last")).where("b <> last").select("doc_id", "b"), "shared-ids")
    sized = materialise(own.join(twice, "doc_id", "left_semi").distinct(), "shared-sets")
    many = twice.join(sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")), "doc_id")
    linked = attach(sized, many, ["doc_id"], "sets").where("digest <> b")
    ids = nodes.select("digest", "id")
    return linked.join(ids.select("digest", F.col("id").alias("x")), "digest").select("x", F.col("b").alias("digest")).join(ids, "digest").select(F.col("x").alias("a"), F.col("id").alias("b"))


def near_sets(docs: DataFrame, width: int, percent: int, one_node_per_id: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n, digest, ...), and of their distinct sets (digest, size, component, least).

    least is the smallest doc_id of the set's rows; component is any number that the
    sets of one component share. With one_node_per_id the sets of rows that share a
    doc_id are linked, whatever their texts.
    """
    marked = materialise(sketches(docs, width), "sketches")
    nodes = marked.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key", "n", "bands", "sketch")).alias("s"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size"))
    nodes = materialise(nodes.select("digest", "size", "least", "s.*").withColumn("id", F.monotonically_increasing_id()), "nodes")
    members = _members(nodes.select("id", F.explode("bands").alias("key")), nodes, "members")
    close, stars = materialise(_all_pairs(members, percent), "close"), materialise(_stars(members, percent), "stars")
    large = members.where(F.col("sets") > SMALL_BUCKET).select("key", "id")
    wanted = close.select(F.col("a").alias("id")).union(close.select("b")).union(large.select("id")).distinct()
    links = Links(_sets_of(docs, nodes.join(wanted, "id", "left_semi"), width), percent)
    if one_node_per_id:
        links.add(_shared_ids(marked, nodes))
    best = close.select("a", "b", "differ").unionByName(close.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ")).groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
    links.confirm(best.unionByName(stars.groupBy("a").agg(F.max_by("b", F.struct("company", "b")).alias("b"))))
    links.confirm(links.apart(close.select("a", "b")))
    doubtful = materialise(links.divided(large).select("id").distinct(), "doubtful")
    if not doubtful.isEmpty():
        own = links.sets.join(doubtful, "id", "left_semi")
        early = early_items(own, percent, rarity(own)).join(nodes.select("id", "sketch"), "id")
        hub_rounds(materialise(early, "early"), links)
    return marked, links.component(nodes.select("id", "digest", "size", "least")).drop("id")


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Whole sets (id, items) of nodes, each from one row that has it."""
    chosen = materialise(nodes.select("id", "digest", F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")), "wanted")
    pick = chosen.select("_d", "_t")
    rows = _keyed(docs).join(F.broadcast(pick) if pick.count() <= FEW_ROWS else pick, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left_semi")
    return materialise(whole_sets(rows, width).dropDuplicates(["digest"]).join(chosen.select("id", "digest"), "digest").select("id", "items"), "sets")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A
    text of fewer words than width has one shingle, its whole sequence; null and
    wordless texts have none and stand alone. Links need 100 * intersection >=
    percent * union. Equal sets are linked. Rows that share a doc_id are one node:
    the sets of all their texts are linked. A row without a doc_id links others like
    any row; its component_id is null only if no row of the component has one.
    An empty table gives no rows.
    """
    marked, sets = near_sets(docs, width, percent, True)
    sets = materialise(sets, "components")
    least = sets.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    labelled = attach(sets.select("component", "digest", "size"), materialise(least, "least"), ["component"], "sets").select("digest", "size", "component_id")
    full = attach(marked.where("n > 0").select("doc_id", "n", "digest"), materialise(labelled, "labelled"), ["digest"], "size").select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of the texts of a component one stays.

    It is the one with the smallest doc_id (null last, then by the text's hash). Rows are told
    apart by doc_id and text together, so texts that share a doc_id, or have none, are kept or
    dropped on their own; rows equal in both count once. Texts without a word all stay.
    """
    marked, sets = near_sets(docs, width, percent, False)
    own = attach(marked.where("n > 0").select("doc_id", "text_key", "digest"), materialise(sets.select("digest", "size", "component"), "components"), ["digest"], "size")
    own = materialise(own.select("component", F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"), "near-rows")
    stay = own.groupBy("component").agg(F.min(F.struct("none", "doc_id", "text_key")).alias("s")).select("s.*").withColumn("_stays", F.lit(True))
    gone = own.distinct().join(stay, (own["doc_id"].eqNullSafe(stay["doc_id"])) & (own["text_key"] == stay["text_key"]), "left_anti").select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"))
    gone = materialise(gone.distinct(), "near-gone")
    keyed = docs.withColumn("_own", text_key("text"))
    left = keyed.join(F.broadcast(gone) if gone.count() <= FEW_ROWS else gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_own") == F.col("_t")), "left_anti")
    twice = marked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return (left if twice.isEmpty() else left.dropDuplicates(["doc_id", "_own"])).drop("_own")
