"""Exact Jaccard self-join of n-gram sets with set-relation skipping (operator 4).

1. *Sets.* Every text becomes its set of word n-grams as 64-bit hashes; equal sets are one set from here on. Sets are told
   apart by a 64-bit hash of their elements.
2. *Index lists.* All sets list their elements in one global order, rare ones first, and enter the list of each element of
   their prefix, which two similar sets must share. The order takes counts of all n-grams of all documents in a fixed
   number of counters; any order gives right results, a good one gives short lists.
3. *Answers of one set.* In each list the set with the fewest elements before this one is the hub. Each set is compared with the
   hub that it meets most often; if they are similar, the set joins the hub's family and keeps what it has more and less.
   So a family costs as many comparisons as it has members.
4. *Index-level skipping.* Lists are cut into blocks by size and position of their entries. A set skips blocks whose sizes or
   positions cannot give enough overlap. In each list the entries of the component that has most of them don't probe each
   other, since they are connected already.
5. *Answer-level skipping.* A candidate that belongs to a family isn't compared in full: the overlap of its hub with the other set,
   computed once for the whole family, is corrected by the few elements that the candidate has more and less.
6. *Components* of all links, by alternating stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from storyspark.llm.common import id_filter, kept_in_worker, may_hold, partitions, slices
from storyspark.llm.pieces import Answers
from storyspark.operators.graph import connected_components
from storyspark.session import stage

#: Words whose hash a Python worker keeps, about 150 bytes each.
KEPT_WORDS = 200_000
#: Counters for the frequency of n-grams, in chunks that are summed one by one: 32 MB for each task that counts, 8 MB for each that orders sets.
COUNTERS, CHUNK = 2**23, 2**16
#: Counting tasks per core: each sends its counters on, so their number must not grow with the documents.
COUNTING_TASKS = 2
#: An index list that may get more entries than this is dealt by sets instead of meeting in one task. Counters never count too few.
HOT_LIST = 100_000
#: Sets that a task remembers to have listed already.
LISTED_SETS = 200_000
#: Bits of a set's signature.
SIGNATURE_BITS = 512
#: Lists of up to this many entries are looked through before anything is made of them.
SHORT = 16
#: Earlier shared elements that an entry carries, so that most pairs are met only once.
CARRIED = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Two sets link when ``100 * intersection >= percent * union``; n-grams have ``n`` words."""

    n: int = 4
    percent: int = 85

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def linked(self, overlap: Column, a: Column, b: Column) -> Column:
        return 100 * overlap >= self.percent * (a + b - overlap)

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def enough(self, overlap: Column, a: Column, b: Column) -> Column:
        """Whether an overlap of at most this much can do."""
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def may_link(self, a: Column, b: Column) -> Column:
        """What sizes, positions and signatures of two entries allow; never false for two similar sets at their first shared element."""
        n, m = a["n"], b["n"]
        rest = F.least(n - a["position"], m - b["position"])
        differ = sum(F.bit_count(F.get(a["signature"], F.lit(k)).bitwiseXOR(F.get(b["signature"], F.lit(k)))) for k in range(SIGNATURE_BITS // 64))
        return self.sizes_fit(n, m) & self.enough(rest, n, m) & self.enough((n + m - differ) / 2, n, m)


def _ngrams(text: str, n: int) -> np.ndarray:
    """The hashes of the word n-grams of a text in order; of all its words if they are fewer; none without words."""
    hashes = kept_in_worker("word_hashes", "words", lambda: Answers(xxhash.xxh3_64_intdigest, KEPT_WORDS))
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at the six ASCII white-space characters
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * _STEP + h[k : k + len(out)]
    return out


def shingles(text: str, n: int) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams of a text."""
    return np.unique(_ngrams(text, n))


def _texts(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, text``; rows without id get one by their text, below all usual ids."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = -F.shiftrightunsigned(F.xxhash64(text), 1) - 1
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, made).alias("row_id"), doc_id.alias("doc_id"), text.alias("text"))


def _frequencies(texts: DataFrame, n: int, counters: int) -> np.ndarray:
    """How frequent all n-grams are, by the top bits of their hash: ``counters`` bytes on a logarithmic scale, whatever the corpus."""
    shift = np.uint64(64 - int(math.log2(counters)))
    chunk = min(CHUNK, counters)

    def rows(chunks) -> Iterator[pa.RecordBatch]:
        for k, numbers in chunks:
            if numbers.any():
                small = numbers.astype(np.min_scalar_type(int(numbers.max())))
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()])], ["chunk", "width", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(counters, np.uint32)
        for part in (part for batch in batches for part in slices(batch, "text")):
            for text in part.column(0).to_pylist():
                np.add.at(found, (_ngrams(text, n) >> shift).astype(np.int64), 1)
        yield from rows(enumerate(found.reshape(-1, chunk)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, None
        scale = lambda numbers: np.minimum(8 * np.log2(1.0 + numbers), 255).astype(np.uint8)
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != at:
                    if at is not None:
                        yield from rows([(at, scale(found))])
                    at, found = row["chunk"], np.zeros(chunk, np.int64)
                found += np.frombuffer(row["counts"], f"<u{row['width']}")
        if at is not None:
            yield from rows([(at, scale(found))])

    schema = "chunk int, width int, counts binary"
    few = texts.select("text").coalesce(COUNTING_TASKS * texts.sparkSession.sparkContext.defaultParallelism)
    partial = few.mapInArrow(count, schema)
    summed = partial.repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(add, schema)
    out = np.zeros(counters, np.uint8)
    for row in summed.collect():  # at most counters / chunk rows of one chunk each
        out[row.chunk * chunk : (row.chunk + 1) * chunk] = np.frombuffer(row.counts, np.uint8)
    return out


def _hot(entries: int) -> int:
    """The least value of a counter that may stand for more than ``entries``."""
    return int(8 * math.log2(1.0 + entries))


def _scan(texts: DataFrame, rule: Rule, counters: int, hot_list: int = HOT_LIST) -> DataFrame:
    """``row_id, doc_id, n, set_id, signature, wide, prefix, hot_from`` of every document.

    The prefix is in order of frequency; from ``hot_from`` on its lists may be longer than ``hot_list``. A task gives the prefix of a set
    once: rows that repeat it, such as exact copies, have an empty one.

    A signature has, for each class of elements by hash, whether their number is odd: where two signatures differ, the sets differ in
    at least one element. The short one has :data:`SIGNATURE_BITS` classes and goes with every entry; the wide one has about as many as the set has
    elements, a power of two times that.
    """
    known = texts.sparkSession.sparkContext.broadcast(_frequencies(texts, rule.n, counters))
    shift = np.uint64(64 - int(math.log2(counters)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, listed, hot = known.value, set(), _hot(hot_list)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sizes, sets, odd, wide, prefixes, hot_from = [], [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, rule.n)
                bits = SIGNATURE_BITS << max(0, (len(s) - 1) // SIGNATURE_BITS).bit_length()
                parity = np.packbits((np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)
                wide.append(parity)
                odd.append(np.bitwise_xor.reduce(parity.reshape(-1, SIGNATURE_BITS // 64)))
                sizes.append(len(s))
                sets.append(_set_id(s))
                values = counts[(s >> shift).astype(np.int64)]
                order = np.argsort(values, kind="stable")[: rule.prefix(len(s)) if len(s) and sets[-1] not in listed else 0]
                prefixes.append(s[order].view(np.int64))
                hot_from.append(int(np.searchsorted(values[order], hot)))
                if len(listed) >= LISTED_SETS:
                    listed.clear()
                listed.add(sets[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sets, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64())), pa.array(hot_from, pa.int32())],
                ["row_id", "doc_id", "n", "set_id", "signature", "wide", "prefix", "hot_from"],
            )

    return texts.mapInArrow(scan, "row_id bigint, doc_id bigint, n bigint, set_id bigint, signature array<bigint>, wide array<bigint>, prefix array<bigint>, hot_from int")


def _set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _whole_sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``set_id, n, items`` of the sets in ``wanted (row_id, set_id)``, made again from one text each.

    A filter over the wanted rows lets texts stay where they are read; only the sets that pass are shuffled.
    """
    passing = id_filter(wanted.select("row_id"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(may_hold(passing.value, ids)))
            for part in slices(some, "text"):
                sets = [shingles(text, n) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([_set_id(s) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["row_id", "set_id", "n", "items"],
                )

    made = texts.select("row_id", "text").mapInArrow(make, "row_id bigint, set_id bigint, n bigint, items array<bigint>")
    # Only where one id has several rows can a set come twice.
    return made.join(wanted, ["row_id", "set_id"]).dropDuplicates(["set_id"]).drop("row_id")


def _size_band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) * 8).cast("int")


def _position_band(position: Column, n: Column) -> Column:
    """0 to 4 over the first fifth of the elements."""
    return F.least(F.floor(25 * position / n), F.lit(4)).cast("int")


def _reachable(n: Column, position: Column, rule: Rule) -> Column:
    """The blocks that an entry cannot skip: size bands, and in each the last position band that leaves enough overlap."""
    ratio = rule.percent / 100
    low = F.floor(F.log(n * ratio - 1e-9) * 8).cast("int")
    high = F.floor(F.log(n / ratio + 1e-9) * 8).cast("int")
    need = rule.percent / (100 + rule.percent)

    def blocks(band: Column) -> Column:
        # Partners in this band have at least `least` elements; one at share q of its elements can overlap in (1 - q) of them.
        least, most = F.greatest(F.exp(band / 8) - 1e-6, n * ratio), F.least(F.exp((band + 1) / 8) + 1e-6, n / ratio)
        own_do = (n - position) >= need * (n + least) - 1e-6
        last = F.greatest(F.floor(25 * (1 - need * (1 + n / most)) + 1e-6), F.lit(-1)).cast("int")
        return F.struct(band.alias("size_band"), F.when(own_do, F.least(last, F.lit(4))).otherwise(-1).alias("last_band"))

    return F.filter(F.transform(F.sequence(low, high), blocks), lambda block: block["last_band"] >= 0)


def join_components(docs: DataFrame, rule: Rule | None = None, counters: int = COUNTERS, hot_list: int = HOT_LIST) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable by links, the row's own included. Words are runs of characters other than ASCII
    white space, A-Z lower-cased. A text with fewer words than ``n`` is one n-gram; null texts and texts without words have
    no set and link with nothing. Rows of equal texts share a component. A row without id has none unless it is connected
    to a row with one. Rows of one id with different texts keep their own sizes and components. Other columns are not used; an
    empty table gives no rows. A long text takes time and memory in proportion to it.
    """
    rule = rule or Rule()
    texts = _texts(docs)
    scanned = stage(_scan(texts, rule, counters, hot_list), "ngram-scan")
    roots, links = _links(texts, scanned, rule)
    # Links between families join their roots; those are few, so this takes less than the components of all links.
    of = lambda name: roots.select(F.col("set_id").alias(name), F.col("root").alias(f"{name}_root"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    tops = connected_components(between).select(F.col("id").alias("root"), F.col("root").alias("top"))
    rows = scanned.select("doc_id", "row_id", "n", "set_id")
    rooted = rows.filter("n > 0").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rooted = rooted.join(tops, "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members"))
    connected = rooted.join(smallest.filter("members > 1"), "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return connected.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _links(texts: DataFrame, scanned: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """``(set_id, root)`` of connected families, and links ``u, v`` that connect those and the other sets."""
    listed = F.sort_array(F.collect_list(F.struct("position", "item"))).alias("entries")
    met = _shared_entries(scanned, rule).groupBy("set_id").agg(listed)
    known = scanned.filter("size(prefix) > 0").select("set_id", "n", "signature").dropDuplicates(["set_id"])
    shared = stage(met.join(known, "set_id").select("set_id", "n", "signature", "entries"), "ngram-shared")
    lists = shared.select("set_id", "n", "signature", F.inline("entries"))
    best = stage(_plausible(_best_hubs(lists, rule), "set_id", "hub", scanned, rule), "ngram-hubs")
    family = stage(_families(best, _whole_sets(texts, _rows_of(scanned, best, "set_id", "hub"), rule.n), rule), "ngram-families")
    close = family.select(F.col("set_id").alias("u"), F.col("hub").alias("v"))
    roots = connected_components(close).select(F.col("id").alias("set_id"), "root")
    candidates = stage(_plausible(_candidates(shared, roots, rule), "a", "b", scanned, rule), "ngram-candidates")
    oriented = stage(_oriented(candidates, family), "ngram-oriented")
    whole = stage(_whole_sets(texts, _rows_of(scanned, oriented, "base", "other"), rule.n), "ngram-sets")
    return roots, stage(_derived(oriented, whole, rule), "ngram-links")


def _shared_entries(scanned: DataFrame, rule: Rule) -> DataFrame:
    """``set_id, item, position``: the entries of lists in which their set may meet a similar one.

    Entries travel alone, without what is known of their set. A list that may be long goes on as it is, dealt by sets; in any other, entries that
    have it for themselves go, and from a short one those beside which no size and position fits.
    """
    spread = scanned.select("set_id", "n", "hot_from", F.posexplode("prefix").alias("position", "item"))
    hot = spread.filter("position >= hot_from").select("set_id", "item", "position").distinct()
    # Size and position in one number: an entry is three of them. Equal entries come from copies of one set in several tasks.
    at = (F.shiftleft("n", 31) + F.col("position")).alias("at")
    entries = spread.filter("position < hot_from").select("item", "set_id", at).repartition(partitions(scanned.sparkSession), "item")
    by_item = W.partitionBy("item").orderBy("set_id")
    once = entries.withColumn("before", F.lag("set_id").over(by_item)).filter(~F.col("before").eqNullSafe(F.col("set_id"))).drop("before")
    met = once.withColumn("sets", F.count("*").over(W.partitionBy("item"))).filter("sets > 1")
    # A frame of fixed size holds all of a short list.
    around = by_item.rowsBetween(-SHORT, SHORT)
    met = met.withColumn("around", F.collect_list(F.struct("set_id", "at")).over(around))
    me = {"n": F.shiftright("at", 31), "position": F.col("at").bitwiseAND(2**31 - 1)}

    def fits(other: Column) -> Column:
        n, position = F.shiftright(other["at"], 31), other["at"].bitwiseAND(2**31 - 1)
        rest = F.least(me["n"] - me["position"], n - position)
        return (other["set_id"] != F.col("set_id")) & rule.sizes_fit(me["n"], n) & rule.enough(rest, me["n"], n)

    met = met.filter((F.col("sets") > SHORT) | F.exists("around", fits))
    return met.select("set_id", "item", me["position"].cast("int").alias("position")).unionByName(hot)


def _plausible(pairs: DataFrame, a: str, b: str, scanned: DataFrame, rule: Rule) -> DataFrame:
    """The pairs of sets that their wide signatures allow."""
    wide = scanned.filter("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("wide").alias("wide"))
    of = lambda name: wide.select(F.col("set_id").alias(name), F.col("n").alias(f"{name}_n"), F.col("wide").alias(f"{name}_wide"))
    both = pairs.join(of(a), a).join(of(b), b)

    def folded(mine: Column, other: Column) -> Column:
        """At the width of the narrower one; sizes that fit are at most one doubling apart."""
        half = (F.size(mine) / 2).cast("int")
        halves = F.zip_with(F.slice(mine, F.lit(1), half), F.slice(mine, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(mine) > F.size(other), halves).otherwise(mine)

    x, y = F.col(f"{a}_wide"), F.col(f"{b}_wide")
    odd = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    differ = F.aggregate(odd, F.lit(0), lambda total, d: total + d)
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return both.filter(rule.enough((n + m - differ) / 2, n, m)).select(*pairs.columns)


def _rows_of(scanned: DataFrame, frame: DataFrame, *columns: str) -> DataFrame:
    """``row_id, set_id`` of one text of each set that the columns name."""
    ids = frame.select(F.explode(F.array(*columns)).alias("set_id")).distinct()
    return scanned.join(ids, "set_id").groupBy("set_id").agg(F.min("row_id").alias("row_id"))


def _best_hubs(entries: DataFrame, rule: Rule) -> DataFrame:
    """``set_id, hub``: the hub that a set meets in most of its lists, among those that it may be similar to."""
    hubs = entries.groupBy("item").agg(F.min(F.struct("position", "n", "set_id", "signature")).alias("hub"))
    me = F.struct("n", "position", "signature")
    met = entries.withColumn("me", me).join(hubs, "item").filter((F.col("hub.set_id") != F.col("set_id")) & rule.may_link(F.col("me"), F.col("hub")))
    votes = met.groupBy("set_id", F.col("hub.set_id").alias("hub")).agg(F.count("*").alias("votes"))
    return votes.groupBy("set_id").agg(F.max(F.struct("votes", "hub"))["hub"].alias("hub"))


def _families(best: DataFrame, whole: DataFrame, rule: Rule) -> DataFrame:
    """``set_id, hub, more, less`` of the sets that are similar to their hub."""
    whole = stage(whole, "ngram-hub-sets")
    of_hub = whole.select(F.col("set_id").alias("hub"), F.col("n").alias("hub_n"), F.col("items").alias("hub_items"))
    compared = best.join(of_hub, "hub").join(whole, "set_id").withColumn("overlap", F.size(F.array_intersect("items", "hub_items")))
    similar = compared.filter(rule.linked(F.col("overlap"), F.col("n"), F.col("hub_n")))
    return similar.select("set_id", "hub", F.array_except("items", "hub_items").alias("more"), F.array_except("hub_items", "items").alias("less"))


def _candidates(shared: DataFrame, roots: DataFrame, rule: Rule) -> DataFrame:
    """``a, b``: pairs of sets in different components that may be similar, each at least at its first shared element."""
    rooted = shared.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    items = F.transform("entries", lambda e: e["item"])
    by_root = rooted.select("root", F.explode(items).alias("item")).groupBy("item", "root").agg(F.count("*").alias("entries"))
    mixed = by_root.groupBy("item").agg(F.max(F.struct("entries", "root"))["root"].alias("main"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    placed = rooted.select("set_id", "n", "signature", "root", "entries", F.posexplode(items).alias("k", "item")).select(
        "set_id",
        "n",
        "signature",
        "root",
        "item",
        F.get("entries", F.col("k"))["position"].alias("position"),
        F.slice(items, F.lit(1), F.least(F.col("k"), F.lit(CARRIED))).alias("earlier"),
    )
    lists = placed.join(mixed, "item")
    probes = lists.filter("root <> main").select(
        "item", "set_id", "n", "signature", "position", "root", "earlier", F.inline(_reachable(F.col("n"), F.col("position"), rule))
    )
    lists = lists.withColumn("size_band", _size_band(F.col("n"))).withColumn("position_band", _position_band(F.col("position"), F.col("n")))
    a, b = probes.alias("a"), lists.alias("b")
    pairs = a.join(
        b,
        (F.col("a.item") == F.col("b.item"))
        & (F.col("a.size_band") == F.col("b.size_band"))
        & (F.col("b.position_band") <= F.col("a.last_band"))
        & (F.col("a.root") != F.col("b.root"))
        & ((F.col("b.root") == F.col("b.main")) | (F.col("a.set_id") < F.col("b.set_id")))
        & rule.may_link(*(F.struct(f"{x}.n", f"{x}.position", f"{x}.signature") for x in "ab"))
        & ~F.arrays_overlap("a.earlier", "b.earlier"),
    )
    ids = F.col("a.set_id"), F.col("b.set_id")
    return pairs.select(F.least(*ids).alias("a"), F.greatest(*ids).alias("b")).distinct()


def _oriented(candidates: DataFrame, family: DataFrame) -> DataFrame:
    """``member, other, base, more, less``: one side of each pair as what its hub, if it has one, needs to become it."""
    of = lambda name: family.select(F.col("set_id").alias(name), F.col("hub").alias(f"{name}_hub"), F.col("more").alias(f"{name}_more"), F.col("less").alias(f"{name}_less"))
    known = candidates.join(of("a"), "a", "left").join(of("b"), "b", "left")
    by_b = F.col("b_hub").isNotNull() | F.col("a_hub").isNull()
    none = F.array().cast("array<bigint>")
    return known.select(
        F.when(by_b, F.col("b")).otherwise(F.col("a")).alias("member"),
        F.when(by_b, F.col("a")).otherwise(F.col("b")).alias("other"),
        F.when(by_b, F.coalesce("b_hub", "b")).otherwise(F.col("a_hub")).alias("base"),
        F.coalesce(F.when(by_b, F.col("b_more")).otherwise(F.col("a_more")), none).alias("more"),
        F.coalesce(F.when(by_b, F.col("b_less")).otherwise(F.col("a_less")), none).alias("less"),
    )


def _derived(oriented: DataFrame, whole: DataFrame, rule: Rule) -> DataFrame:
    """``u, v``: the candidates that are similar, by the overlap of a hub and what its member has more and less."""
    others = whole.select(F.col("set_id").alias("other"), F.col("n").alias("other_n"), F.col("items").alias("other_items"))
    bases = whole.select(F.col("set_id").alias("base"), F.col("n").alias("base_n"), F.col("items").alias("base_items"))
    once = oriented.select("base", "other").distinct().join(bases, "base").join(others, "other")
    once = once.select("base", "other", "base_n", F.size(F.array_intersect("base_items", "other_items")).alias("common"))
    rows = oriented.join(once, ["base", "other"]).join(others, "other")
    overlap = F.col("common") + F.size(F.array_intersect("more", "other_items")) - F.size(F.array_intersect("less", "other_items"))
    size = F.col("base_n") + F.size("more") - F.size("less")
    return rows.filter(rule.linked(overlap, size, F.col("other_n"))).select(F.col("member").alias("u"), F.col("other").alias("v"))


def one_of_each(docs: DataFrame, rule: Rule, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that a row of a smaller ``doc_id`` in their component stands for.

    Documents without words and rows without id that are connected to no row with one all stay. Of equal rows of one id
    one stays. Columns are those of ``docs``. Only rows that may go, or whose id occurs twice, are shuffled with their texts.
    """
    joined = stage(join_components(docs, rule, counters), "ngram-components")
    goes = (F.col("n_shingles") > 0) & F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))
    going = joined.filter(goes).select("doc_id").distinct()
    twice = joined.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    passing = id_filter(going.unionByName(twice))

    @F.arrow_udf("boolean")
    def may_go(ids: pa.Array) -> pa.Array:
        return pa.array(may_hold(passing.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) | np.array(ids.is_null()))

    marked = docs.withColumn("_may_go", may_go(F.col("doc_id").cast("bigint")))
    doubtful = marked.filter("_may_go").drop("_may_go")
    gone = going.select(F.col("doc_id").alias("_id"))
    kept = doubtful.join(gone, doubtful["doc_id"].cast("bigint").eqNullSafe(gone["_id"]), "left_anti").dropDuplicates(docs.columns)
    return marked.filter("not _may_go").drop("_may_go").unionByName(kept)
