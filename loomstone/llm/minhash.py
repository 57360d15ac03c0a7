"""Near-duplicate removal by an inverted join over MinHash coordinates.

1. Each text gets its set of hashed five-word shingles and a signature of
   ``COORDINATES`` minima. Texts with the same set form a class; from here on
   a class counts once, so exact copies never meet in pairs.
2. Classes are posted under every (coordinate, value). Lists of one class are
   dropped. Of its lists, rarest first, a class merges the first
   SHARED - MATCHES + 1 and skips the MATCHES - 1 longest: classes that agree in
   MATCHES coordinates or more meet in a merged one, and the skipped ones are
   probed in the signatures of the pairs that met.
3. In each list, classes meet one leader, the class that shares the most list
   places overall. Collisions of a pair are counted, pairs under the threshold
   dropped, the others confirmed on the full sets; links merge classes into
   components.
4. What may still link components: a class needs MATCHES lists that hold another
   component, and three quarters of its shingles must occur in another one. Such
   classes are described by their difference to the leader of a list. Given the
   sizes, a link of two classes needs a certain number of shared differences, and
   that number is a sum of one term for each class. So each class posts only a
   prefix of its differences, rarest first, and a pair that meets there is decided
   by counting. Members of a large group of near copies have few differences in
   common, so its stragglers are settled without pairing them with the group.
5. Components take the smallest doc_id that they hold.

A link at similarity 0.75 agrees in 36 of 48 coordinates on average and is
missed with a probability under 1e-6 (fewer than 20). Sets hold 64-bit hashes.

Defined results: null texts and texts without words have an empty set and stay
alone; a text of fewer than five words has one shingle; rows that repeat an id
are rows of their own, each in the component of its text; rows without id join a
component but never name it; whole texts are read, long ones in parts; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.text_bytes import as_bytes, bounded, parts_of_words, split_at
from loomstone.staging import Staged, if_small

SHINGLE = 5
COORDINATES = 48
MATCHES = 20
PERCENT = 75
HEIGHT = 2 * (100 + PERCENT)
PART_BYTES = 8 << 20

WORD_BYTE = np.ones(256, bool)
WORD_BYTE[np.r_[0x09:0x0E, 0x20]] = False
_seeded = np.random.default_rng(20240501)
BYTE_VALUE = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_VALUE[0x41:0x5B] = BYTE_VALUE[0x61:0x7B]
MULTIPLIERS = _seeded.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
BASE = int(_seeded.integers(1, 1 << 61)) * 2 + 1


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, A-Z taken as a-z: a polynomial over its bytes, from running sums."""
    up, down = _powers(BASE, len(data)), _powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[data] * up, dtype=np.uint64)))
    return _scramble((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Hash of every run of ``SHINGLE`` word hashes."""
    mixed = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        mixed = _scramble(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(mixed)])
    return mixed


def _long_set(data: np.ndarray) -> np.ndarray:
    """The set of one long text, part by part; each part begins with the last words of the one before."""
    found, carried = [], np.zeros(0, np.uint64)
    for a, b in parts_of_words(data, WORD_BYTE, PART_BYTES):
        part = data[a:b]
        starts, ends, _ = split_at(WORD_BYTE[part], np.array([0, len(part)]))
        hashes = np.concatenate((carried, word_hashes(part, starts, ends)))
        found.append(np.unique(_mixed(hashes)))
        carried = hashes[-(SHINGLE - 1) :]
    return np.unique(np.concatenate(found)) if sum(map(len, found)) else _short_set(carried)


def _short_set(hashes: np.ndarray) -> np.ndarray:
    """The one shingle of fewer words than a shingle has; none without words."""
    short = np.array([len(hashes)], np.uint64)
    for h in hashes:
        short = _scramble(short * np.uint64(0x9E3779B97F4A7C15) + h)
    return short if len(hashes) else np.zeros(0, np.uint64)


def shingle_sets(text: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = as_bytes(text)
    if len(text) == 1 and len(data) > PART_BYTES:
        return [_long_set(data)]
    starts, ends, owner = split_at(WORD_BYTE[data], offsets)
    hashes = word_hashes(data, starts, ends)
    first = np.searchsorted(owner, np.arange(len(text) + 1))
    mixed = _mixed(hashes)
    return [np.unique(mixed[a : b - SHINGLE + 1]) if b - a >= SHINGLE else _short_set(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of ``COORDINATES`` orders of the shingles."""
    least = np.full(COORDINATES, np.uint32(0xFFFFFFFF), np.uint32)
    for at in range(0, len(shingles), 4096):
        orders = (shingles[at : at + 4096, None] * MULTIPLIERS[None, :]) >> np.uint64(32)
        least = np.minimum(least, orders.min(axis=0).astype(np.uint32))
    return least.view(np.int32)


def _digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        sets = shingle_sets(batch.column("text"))
        columns = [
            batch.column("doc_id").cast(pa.int64()),
            batch.column("text_key"),
            batch.column("key_b"),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s) for s in sets], pa.binary()),
            pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "key_b", "n", "cls", "sig"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded(batches):
        sets = shingle_sets(batch.column("text"))
        arrays = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["cls", "shingles"])


def connected(edges: DataFrame, name: str) -> Staged:
    """Smallest reachable node (node, comp) of every node of ``edges`` (a, b).

    Each round takes the least label among neighbours, then the label of that
    label; rounds end when nothing changes. Labels are written each round.
    """
    both = Staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    first = both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp"))
    labels = Staged(first, f"{name}-labels")
    while True:
        near = both.df.join(labels.df, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("near"))
        lower = labels.df.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("near", "comp")).alias("comp"))
        jump = labels.df.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        after = Staged(lower.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was"), f"{name}-labels")
        moved = after.df.where(F.col("comp") != F.col("was")).limit(1).count()
        labels.drop()
        labels = after
        if not moved:
            both.drop()
            return labels


def _postings(classes: DataFrame) -> DataFrame:
    """(cls, n, reach, j, v, merged) of lists of several classes; reach sums their sizes, merged marks the rarest."""
    posted = classes.select("cls", "n", F.posexplode("sig").alias("j", "v"))
    lists = posted.groupBy("j", "v").agg(F.count("*").alias("size")).where("size > 1")
    shared = posted.join(lists, ["j", "v"])
    ranked = shared.groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("size", "j", "v"))).alias("lists"), F.sum("size").alias("reach"))
    # Lists of one class come first in the order and hold no partner; the prefix is counted from the others.
    most = F.size("lists") - (MATCHES - 1)
    marked = F.transform("lists", lambda x, k: F.struct(x["j"].alias("j"), x["v"].alias("v"), (k < most).alias("merged")))
    return ranked.where(most > 0).select("cls", "n", "reach", F.inline(marked))


def _leaders(postings: DataFrame) -> DataFrame:
    """(j, v, leader, led_by): the class of each list that shares the most list places, and its component."""
    order = F.struct("reach", "cls")
    return postings.groupBy("j", "v").agg(F.max_by("cls", order).alias("leader"), F.max_by("comp", order).alias("led_by"))


def _collisions(postings: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class and the leader of one of its merged lists, with the number of lists in which they collide."""
    led = postings.join(_leaders(postings), ["j", "v"]).where(F.col("comp") != F.col("led_by"))
    return led.groupBy(F.least("cls", "leader").alias("a"), F.greatest("cls", "leader").alias("b")).agg(F.count("*").alias("met"))


def _linked(common: str, n_a: str, n_b: str) -> Column:
    return 100 * F.col(common) >= PERCENT * (F.col(n_a) + F.col(n_b) - F.col(common))


class _Confirmer:
    """Confirms candidate pairs on signatures, then on full sets."""

    def __init__(self, docs: DataFrame, classes: DataFrame):
        self.docs, self.classes = docs, classes

    def __call__(self, pairs: DataFrame) -> Staged:
        """The links (a, b) among pairs (a, b, met)."""
        columns = ("n", "sig", "doc_id", "text_key")
        left, right = (self.classes.select(F.col("cls").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns]) for k in "ab")
        skipped = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda same: same))
        enough = F.when(F.col("met") >= MATCHES, True).otherwise(skipped >= MATCHES)
        alike = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
        met = pairs.join(left, "a").join(right, "b").where(alike & enough)
        likely = Staged(met.select("a", "b", "n_a", "n_b", "doc_id_a", "text_key_a", "doc_id_b", "text_key_b"), "likely")
        ends = likely.df.select(F.col("doc_id_a").alias("doc_id"), F.col("text_key_a").alias("text_key"))
        sets = self.sets(ends.union(likely.df.select("doc_id_b", "text_key_b")).distinct())
        a, b = (sets.df.select(F.col("cls").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
        common = F.size(F.array_intersect("set_a", "set_b")).alias("common")
        both = likely.df.select("a", "b", "n_a", "n_b").join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", common)
        links = Staged(both.where(_linked("common", "n_a", "n_b")).select("a", "b"), "links")
        likely.drop()
        sets.drop()
        return links

    def sets(self, ends: DataFrame) -> Staged:
        """Full sets (cls, shingles) of the classes that stand in the given places (doc_id, text_key)."""
        ends = Staged(ends, "ends")
        # Ids and keys are compared null-safely; what else they let through is dropped by class.
        wanted = if_small(ends).withColumnRenamed("doc_id", "want_id").withColumnRenamed("text_key", "want_key")
        texts = self.docs.join(wanted, self.docs["text_key"].eqNullSafe(wanted["want_key"]) & self.docs["doc_id"].eqNullSafe(wanted["want_id"]), "left_semi").select("text")
        found = texts.mapInArrow(_set_batches, "cls binary, shingles array<long>").where(F.col("cls").isNotNull())
        sets = Staged(found.dropDuplicates(["cls"]), "sets")
        ends.drop()
        return sets


def _several(named: DataFrame) -> DataFrame:
    """Postings of lists that hold several components."""
    mixed = named.groupBy("j", "v").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    return named.join(mixed.select("j", "v"), ["j", "v"])


def _open(postings: DataFrame, labels: DataFrame) -> Staged:
    """Postings with their component, of classes that collide with other components often enough for a link."""
    named = postings.join(labels.select(F.col("node").alias("cls"), "comp"), "cls", "left")
    mixed = Staged(_several(named.withColumn("comp", F.coalesce("comp", "cls"))), "mixed-lists")
    often = mixed.df.groupBy("cls").agg(F.count("*").alias("met")).where(F.col("met") >= MATCHES).select("cls")
    found = Staged(_several(mixed.df.join(often, "cls", "left_semi")), "open-lists")
    mixed.drop()
    return found


def _linkable(confirm: _Confirmer, lists: DataFrame) -> Staged:
    """Sets (cls, shingles) of open classes of whose shingles so many occur in other components that a link is possible."""
    classes = Staged(lists.select("cls", "comp").distinct(), "open-classes")
    sets = confirm.sets(classes.df.join(confirm.classes, "cls").select("doc_id", "text_key"))
    each = classes.df.join(sets.df, "cls").select("cls", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    across = each.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    shared = each.join(across, "shingle", "left_semi").groupBy("cls", "n").agg(F.count("*").alias("shared"))
    wanted = shared.where(100 * F.col("shared") >= PERCENT * F.col("n")).select("cls")
    found = Staged(sets.df.join(wanted, "cls", "left_semi"), "linkable")
    classes.drop()
    sets.drop()
    return found


def _described(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Each class beside the leader of one of its lists: (leader, cls, side, height, delta, beside).

    delta holds the shingles that one of the two has and the other has not. Two
    classes of a leader have |a| + |b| - ... shingles in common, which makes them
    linked if they share (height a + height b) / HEIGHT differences or more. A class
    whose height and the leader's sum to 0 or less is linked to the leader
    (beside) and stands on the leader's side.
    """
    members = lists.join(_leaders(lists), ["j", "v"]).select("leader", "led_by", "cls", "comp").distinct()
    base = sets.select(F.col("cls").alias("leader"), F.col("shingles").alias("base"))
    facing = members.join(sets, "cls").join(base, "leader")
    missing, extra = F.array_except("base", "shingles"), F.array_except("shingles", "base")
    n, n_base = F.size("shingles").cast("long"), F.size("base").cast("long")
    split = facing.select("leader", "led_by", "cls", "comp", n.alias("n"), n_base.alias("n_base"), missing.alias("missing"), extra.alias("extra"))
    height = 2 * PERCENT * F.col("n") + HEIGHT * F.size("missing") - (100 + PERCENT) * F.col("n_base")
    beside = height + (PERCENT - 100) * F.col("n_base") <= 0
    side = F.when(beside, F.col("led_by")).otherwise(F.col("comp"))
    return split.select("leader", "cls", side.alias("side"), height.alias("height"), F.concat("missing", "extra").alias("delta"), beside.alias("beside"))


def _needing(described: DataFrame) -> DataFrame:
    """Described classes with the differences that they must share with some class of another side (``need``)."""
    lowest = described.groupBy("leader", "side").agg(F.min("height").alias("low"))
    first = lowest.groupBy("leader").agg(F.min(F.struct("low", "side")).alias("first"))
    second = lowest.join(first, "leader").where(F.col("side") != F.col("first.side")).groupBy("leader", "first").agg(F.min("low").alias("second"))
    facing = described.join(second, "leader")
    partner = F.when(F.col("side") == F.col("first.side"), F.col("second")).otherwise(F.col("first.low"))
    need = F.greatest(F.lit(1), F.ceil((F.col("height") + partner) / HEIGHT))
    return facing.withColumn("need", need).where(F.size("delta") >= F.col("need")).select("leader", "cls", "side", "height", "need", "delta")


def _by_differences(lists: DataFrame, sets: DataFrame) -> Staged:
    """The links (a, b) of classes of different components that share a list.

    Only differences found on several sides count, as no others are shared by a
    pair that matters. Of q such differences a class posts the q - need + 1 rarest.
    """
    described = Staged(_described(lists, sets), "described")
    needing = Staged(_needing(described.df), "needing")
    each = needing.df.select("leader", "cls", "side", "height", "need", F.explode("delta").alias("shingle"))
    sizes = each.groupBy("leader", "shingle").agg(F.count("*").alias("size"), F.min("side").alias("low"), F.max("side").alias("high")).where("low <> high")
    held = each.join(sizes.select("leader", "shingle", "size"), ["leader", "shingle"])
    ranked = held.groupBy("leader", "cls", "side", "height", "need").agg(F.array_sort(F.collect_list(F.struct("size", "shingle"))).alias("list"))
    most = F.size("list") - F.col("need") + 1
    posted = ranked.where(most > 0).select("leader", "cls", "side", "height", F.size("list").alias("q"), F.explode(F.slice("list", F.lit(1), most.cast("int"))).alias("x"))
    posted = Staged(posted.select("leader", "cls", "side", "height", "q", F.col("x.shingle").alias("shingle")), "posted-differences")
    a = posted.df.select("leader", "shingle", *[F.col(c).alias(f"{c}_a") for c in ("cls", "side", "height", "q")])
    b = posted.df.select("leader", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("cls", "side", "height", "q")])
    ordered = (F.col("cls_a") < F.col("cls_b")) & (F.col("side_a") != F.col("side_b"))
    reachable = HEIGHT * F.least("q_a", "q_b") >= F.col("height_a") + F.col("height_b")
    met = a.join(b, ["leader", "shingle"]).where(ordered & reachable).select("leader", "cls_a", "cls_b").distinct()
    of_a, of_b = (needing.df.select("leader", *[F.col(c).alias(f"{c}_{k}") for c in ("cls", "height", "delta")]) for k in "ab")
    both = met.join(of_a, ["leader", "cls_a"]).join(of_b, ["leader", "cls_b"])
    shared = HEIGHT * F.size(F.array_intersect("delta_a", "delta_b"))
    links = both.where(shared >= F.col("height_a") + F.col("height_b")).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    to_leader = described.df.where(F.col("beside") & (F.col("cls") != F.col("leader"))).select(F.col("cls").alias("a"), F.col("leader").alias("b"))
    found = Staged(links.unionByName(to_leader).distinct(), "late-links")
    for table in (described, needing, posted):
        table.drop()
    return found


def _merged(labels: Staged, late: DataFrame) -> Staged:
    """Labels after more links between components."""
    of_a, of_b = (labels.df.select(F.col("node").alias(k), F.col("comp").alias(f"comp_{k}")) for k in "ab")
    edges = late.join(of_a, "a", "left").join(of_b, "b", "left")
    edges = edges.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct()
    higher = connected(edges, "components-of-components")
    renamed = higher.df.select(F.col("node").alias("comp"), F.col("comp").alias("after"))
    old = labels.df.select("node", "comp").join(renamed, "comp", "left").select("node", F.coalesce("after", "comp").alias("comp"))
    new = higher.df.join(labels.df.select("node"), "node", "left_anti").select("node", "comp")
    merged = Staged(old.unionByName(new), "components")
    higher.drop()
    labels.drop()
    return merged


def signed_rows(docs: DataFrame) -> Staged:
    """Per row: doc_id, text_key, key_b, n (shingles), cls (digest of the set, null if empty) and sig."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("key_b"))
    return Staged(keyed.mapInArrow(_sign_batches, "doc_id long, text_key long, key_b long, n long, cls binary, sig array<int>"), "signatures")


def class_components(docs: DataFrame, signed: DataFrame) -> Staged:
    """The component of every class: cls, comp, component_id (null where no member has an id)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    by_class = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    classes = Staged(by_class.select("cls", "class_id", "n", "sig", "one.doc_id", "one.text_key"), "classes")
    postings = Staged(_postings(classes.df), "postings")
    confirm = _Confirmer(keyed, classes.df)
    links = confirm(_collisions(postings.df.where("merged").withColumn("comp", F.col("cls"))))
    labels = connected(links.df, "components")
    links.drop()
    lists = _open(postings.df, labels.df)
    postings.drop()
    if lists.df.limit(1).count():
        sets = _linkable(confirm, lists.df)
        merged = Staged(_several(lists.df.where("merged").join(sets.df.select("cls"), "cls", "left_semi")), "linkable-lists")
        late = _by_differences(merged.df, sets.df)
        if late.df.limit(1).count():
            labels = _merged(labels, late.df)
        for table in (sets, merged, late):
            table.drop()
    lists.drop()
    named = classes.df.select("cls", "class_id").join(labels.df.select("node", "comp"), F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    lowest = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    found = Staged(named.select("cls", "comp").join(lowest, "comp").select("cls", "comp", "component_id"), "class-components")
    classes.drop()
    labels.drop()
    return found


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    signed = signed_rows(docs)
    by_class = class_components(docs, signed.df)
    rows = signed.df.select("doc_id", "n", "cls").join(by_class.df.select("cls", "component_id"), "cls", "left")
    own = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def representatives(docs: DataFrame) -> Staged:
    """The one row that stays of each component with words: (doc_id, text_key, key_b, rows).

    It is the row of the smallest id (null last), then of the smallest hash of its
    text; rows counts the rows that repeat both.
    """
    signed = signed_rows(docs)
    by_class = class_components(docs, signed.df)
    named = signed.df.join(by_class.df.select("cls", "comp"), "cls")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "key_b")
    each = named.groupBy("comp", "doc_id", "text_key", "key_b").agg(F.count("*").alias("rows"))
    first = each.groupBy("comp").agg(F.min(F.struct(place.alias("place"), "rows")).alias("first"))
    found = Staged(first.select("first.place.doc_id", "first.place.text_key", "first.place.key_b", "first.rows"), "representatives")
    signed.drop()
    by_class.drop()
    return found


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN m ON m.doc_id = t.doc_id
"""
