"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

1. Every text gets a fingerprint of its words and a BagMinHash signature of its five-word shingles
   (``bag_minhash``), cut into bands. Texts with the same words form a copy group, of which one
   document (the smallest id) goes on; copies are never paired.
2. Documents that share a band stand in one bucket. Pairs are not taken all with all: buckets of up to ``SMALL``
   members are compared in full, and in every larger one its hub, the document that meets the most others over all
   its buckets, is compared with the members. A near-copy group's centre is such a hub, so this links what is
   close to it. What that leaves, members of one bucket in different components, is compared by an exact join (``unsettled``):
   shingles are ordered from rare to common, and two texts that are similar enough share one of the first few.
3. Pairs are verified by the exact weighted Jaccard similarity of their shingles. A hub's members are dealt over
   parts, and each part is streamed past the hub: a task holds one hub and a batch of members. Only the texts
   that share a bucket with another are shuffled for that.
4. Classes are the connected components of the verified links; a class is named by its smallest id. Of a member's links
   one goes on, to its smallest partner, and that one is linked to the others, so the links number little more than the members.

Common keys (fingerprints and bands) are joined by broadcast, their number being bounded by their
share of all rows (``common.join_counted``).

Cases: null texts count as empty; texts without words are alone; texts of fewer than five words
match only the same words; a row with a null id has a null class and links nothing; rows with one id
are one node, also where their texts differ (but for those without words); repeated rows come out repeated; texts of any length are
shingled whole; an empty table gives an empty result; only the two named columns are read, so
other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bag_minhash import mix, overlap, shingles, signatures
from .common import SCAN_CHARS, bound_batches, cut, join_counted, slices, texts_of
from .textstats import Texts

SIMILARITY = 0.8
BANDS, BAND_SLOTS = 28, 5
#: Buckets of up to so many members are compared in full.
SMALL = 5
#: Parts that a hub's members are dealt over to be verified.
PARTS = 16
#: Bins of the shingles' hashes in which they are counted, to order them from rare to common.
BINS = 1 << 18


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for every band of every signature."""
    parts = signature.reshape(len(signature), BANDS, BAND_SLOTS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(BAND_SLOTS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """Per row with an id: doc_id, ``print`` (128-bit hash of the words), ``keys`` (of the bands; none without words)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SCAN_CHARS):
                of = Texts(texts[a:b])
                keys = band_keys(signatures(*shingles(of), of.count, BANDS * BAND_SLOTS))
                some = of.n_words > 0
                prints = [xxhash.xxh3_128_digest(b" ".join(t.encode("utf-8", "surrogatepass").split())) for t in texts[a:b]]
                ends = np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints, pa.binary()), lists], ["doc_id", "print", "keys"])

    read = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(run, f"doc_id {kind}, print binary, keys array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (hub, member) whose texts, the rows of ``texts`` (id, text), are similar enough, with ``similarity``."""
    kind = texts.schema["id"].dataType.simpleString()
    parted = cut(pairs.select("hub", "member", F.pmod(F.xxhash64("member"), F.lit(PARTS)).alias("part")))
    hubs = parted.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("id"), F.lit(0).alias("order"))
    wanted = hubs.unionByName(parted.select("hub", "part", F.col("member").alias("id"), F.lit(1).alias("order")))
    groups = wanted.join(texts, "id").repartition("hub", "part").sortWithinPartitions("hub", "part", "order", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            out: list[tuple] = []
            whose, parts, ids, order = (batch.column(i).to_pylist() for i in range(4))
            texts = texts_of(batch.column(4))
            for a, b in slices(texts, SCAN_CHARS):
                text, hashed, weight = shingles(Texts(texts[a:b]))
                at = np.searchsorted(text, np.arange(b - a + 1))
                for i in range(a, b):
                    own = slice(at[i - a], at[i - a + 1])
                    if order[i] == 0:
                        if current != (whose[i], parts[i]):
                            current, held = (whose[i], parts[i]), (hashed[own].copy(), weight[own].copy())
                    elif current == (whose[i], parts[i]) and (found := overlap(held, (hashed[own], weight[own]))) >= similarity:
                        out.append((whose[i], ids[i], found))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema[0].type), pa.array(columns[1], batch.schema[2].type), pa.array(columns[2], pa.float64())], ["hub", "member", "similarity"])

    return groups.select("hub", "part", "id", "order", "text").mapInArrow(run, f"hub {kind}, member {kind}, similarity double")


def _ordered(texts: DataFrame, bins: np.ndarray | None, similarity: float) -> DataFrame:
    """Of (id, label, small, text): without ``bins`` the number of shingles in every bin of their hashes, with them each
    row's size and first shingles with their places, those of the emptiest bins being first. A shingle that stands w times counts as w."""
    kind, label = (texts.schema[c].dataType.simpleString() for c in ("id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros(BINS, np.int64)
        for batch in batches:
            words = texts_of(batch.column(3))
            for a, b in slices(words, SCAN_CHARS):
                text, hashed, weight = shingles(Texts(words[a:b]))
                text, hashed, last = np.repeat(text, weight), np.repeat(hashed, weight), np.cumsum(weight)
                turn = np.arange(len(text)) - np.repeat(last - weight, weight)
                hashed = mix(hashed + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                held = (hashed % np.uint64(BINS)).astype(np.int64)
                if bins is None:
                    counted += np.bincount(held, minlength=BINS)
                    continue
                order = np.lexsort((hashed, bins[held], text))
                size = np.bincount(text, minlength=b - a)
                place = np.arange(len(text)) - (np.cumsum(size) - size)[text]
                first = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
                some = place < first[text]
                chosen, place = order[some], place[some]
                row = pa.array(text[chosen] + a)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(3)), pa.array(size[text[chosen]]), pa.array(place), pa.array(hashed[chosen].view(np.int64))], ["id", "label", "small", "size", "place", "shingle"])
        if bins is None:
            some = np.flatnonzero(counted)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counted[some])], ["bin", "n"])

    rows = texts.select("id", "label", "small", "text")
    return rows.mapInArrow(run, "bin bigint, n bigint" if bins is None else f"id {kind}, label {label}, small boolean, size bigint, place bigint, shingle bigint")


def _split(live: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (key, rep, label, largest, size) of the larger buckets that have members of several components."""
    named = live.where(F.col("size") > SMALL).select("key", "rep")
    if labels is None:
        named = named.withColumn("label", F.col("rep"))
    else:
        named = named.join(labels.select(F.col("id").alias("rep"), F.col("label").alias("known")), "rep", "left").select("key", "rep", F.coalesce("known", "rep").alias("label"))
    named = cut(named)
    parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "label")).getField("label").alias("largest"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("size")).where("labels > 1").select("key", "largest", "size")
    return cut(join_counted(named, split, "key", "size"))


def unsettled(split: DataFrame, texts: DataFrame, similarity: float) -> DataFrame | None:
    """Pairs (hub, member) in different components that may be similar enough, with all such pairs that share
    a bucket; None if every bucket is one component.

    Two texts of similarity s, of x and y <= x shingles, share s / (1 + s) * (x + y) at least. So in any order of all
    shingles one of the first x - ceil(s * x) + 1 of the larger is one of the first y - ceil(2 * s / (1 + s) * y) + 1 of the smaller,
    and behind its places there are enough others. Of two components in a bucket, one is not its largest: only
    the members of such (``small``) look for partners, so a large group is not paired with itself.
    """
    members = cut(split.groupBy(F.col("rep").alias("id"), "label").agg(F.max(F.col("label") != F.col("largest")).alias("small")))
    if members.limit(1).count() == 0:
        return None
    read = cut(members.join(texts, "id"))
    counts = _ordered(read, None, similarity).groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins = np.zeros(BINS, np.int64)
    bins[counts.column("bin").to_numpy()] = counts.column("n").to_numpy()
    first = cut(_ordered(read, bins, similarity).distinct())
    longer = first.select("shingle", *(F.col(c).alias(f"{c}_l") for c in ("id", "label", "small", "size", "place")))
    lead = F.col("size") - F.ceil(2 * similarity / (1 + similarity) * F.col("size") - 1e-6) + 1
    shorter = first.where(F.col("place") < lead).select("shingle", *(F.col(c).alias(f"{c}_s") for c in ("id", "label", "small", "size", "place")))
    order = (F.col("size_s") < F.col("size_l")) | ((F.col("size_s") == F.col("size_l")) & (F.col("id_s") < F.col("id_l")))
    close = F.col("size_s") >= similarity * F.col("size_l") - 1e-6
    behind = F.least(F.col("size_s") - F.col("place_s"), F.col("size_l") - F.col("place_l")) >= similarity / (1 + similarity) * (F.col("size_s") + F.col("size_l")) - 1e-6
    apart = (F.col("label_s") != F.col("label_l")) & order & close & behind
    asking = longer.where("small_l").join(shorter, "shingle").where(apart)
    asked = longer.where("not small_l").join(shorter.where("small_s"), "shingle").where(apart)
    return asking.unionByName(asked).select(F.col("id_l").alias("hub"), F.col("id_s").alias("member")).distinct()


def _thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as ``links`` (hub, member): of each member its smallest hub, which is
    linked to the member's other hubs. Many members share their hubs, so what is left is little more than the members."""
    least = links.groupBy("member").agg(F.min("hub").alias("least"))
    others = links.join(least, "member").where("hub <> least").select(F.col("least").alias("a"), F.col("hub").alias("b")).distinct()
    return least.select(F.col("least").alias("a"), F.col("member").alias("b")).unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): the smallest id that links lead to.

    Labels go along links to the smaller one, and then to their label's label, until nothing changes.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        told = both.join(labels.select(F.col("id").alias("a"), "label"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("told"))
        lower = labels.join(told, "id").select("id", F.col("label").alias("was"), F.least("label", "told").alias("label"))
        root = labels.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = cut(lower.join(root, "label").select("id", "was", F.least("label", "root").alias("label")))
        changed = new.where("label <> was").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """``labels`` after the links ``found`` (hub, member)."""
    found = cut(found)
    if found.limit(1).count() == 0:
        return labels
    links = _thinned(found)
    return components(links if labels is None else links.unionByName(labels.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs``: doc_id and class_id, the smallest id of its class."""
    signed = cut(sign(docs))
    prints = cut(signed.where(F.size("keys") > 0).groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")))
    rows = prints.select("rep", F.explode("keys").alias("key")).distinct()
    buckets = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = join_counted(rows, buckets, "key", "size")
    live = cut(met.join(met.groupBy("rep").agg(F.sum("size").alias("degree")), "rep"))
    named = live.select(F.col("rep").alias("id")).distinct()
    texts = cut(docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where("text is not null").join(named, "id"))

    few = live.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("rep")).alias("reps")).select("reps").distinct()
    full = few.select(F.posexplode("reps").alias("i", "hub"), "reps").select("hub", F.explode(F.expr("slice(reps, i + 2, size(reps))")).alias("member"))
    large = live.where(F.col("size") > SMALL)
    hubs = cut(large.groupBy("key").agg(F.max(F.struct("degree", "rep")).getField("rep").alias("hub"), F.first("size").alias("size")))
    around = join_counted(large.select("key", F.col("rep").alias("member")), hubs, "key", "size").select("hub", "member")
    labels = _joined(None, verify(full.unionByName(around).where("hub <> member").distinct(), texts, similarity).select("hub", "member"))
    left = unsettled(_split(live, labels), texts, similarity)
    if left is not None:
        labels = _joined(labels, verify(left, texts, similarity).select("hub", "member"))
    copies = join_counted(signed.select("doc_id", "print"), prints.select("print", "rep", "copies"), "print", "copies")
    alone = signed.where(F.size("keys") == 0).select("doc_id", F.col("doc_id").alias("class_id"))
    whole = alone.unionByName(docs.where("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))
    if labels is None:
        return copies.select("doc_id", F.col("rep").alias("class_id")).unionByName(whole)
    named = copies.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select("doc_id", F.coalesce("label", "rep").alias("class_id")).unionByName(whole)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows and columns of ``docs`` that stay: of each class the document with the smallest id (of rows that
    repeat it, one), and all rows with a null id."""
    given = docs.columns
    kept = classes(docs, similarity).where("doc_id = class_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"))
    stay = rows.join(kept, F.col("row.doc_id") == F.col("kept_id"), "left_semi")
    spread = F.xxhash64("row.text") if "text" in given else F.lit(0)
    one = stay.withColumn("order", spread).groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", "order").alias("row")).select("row")
    whole = one.unionByName(rows.where("row.doc_id is null"))
    return whole.select(*(F.col(f"row.`{c}`").alias(c) for c in given))
