"""Near-duplicate groups by an exact n-gram Jaccard join with vertical partitioning.

The n-grams have one global order (rare ones first by a frequency sketch of fixed size, then by hash), and
that order is cut into ``FRAGMENTS``. Of a candidate pair, the overlap inside each fragment is counted on
its own, and the partial counts are summed per pair. Links are pairs with
``DEN * overlap >= NUM * (size + size - overlap)``; components are taken over all links.

1. Equal sets collapse into one (its smallest document id).
2. Screen: a set must share at least NUM/DEN of its n-grams. N-grams of a fixed part of the hash space are
   counted over all sets (combined per slice before the shuffle, n-grams seen twice losing their owner), and
   sets with too many n-grams of their own are done: they have no link.
3. Rounds of first candidates: for each leading n-gram two of its sets are open to proposals, the one with the
   smallest share of n-grams of its own (as the original of a group of edited copies has) and one by a hash
   that differs in each round; a set proposes those of another component that pass the bounds, the nearest
   first. Verified links merge components, until a round finds few.
4. Remaining candidates: all pairs of sets in different components that share an n-gram of their prefixes
   (size - ceil(NUM/DEN * size) + 1 n-grams) and pass the bounds. No such pair is left out, so no link
   between components is lost; pairs inside a component are not needed and never made.

Bounds (none can drop a link): sizes; places in the order of a common prefix n-gram; and a parity bitmap of
256 bits a set, in which two sets differ in at most as many bits as n-grams. The pairs that pass meet a bitmap of
2,048 bits, which also tells large sets apart (random ones differ in half the bits), before overlaps are counted: so
sets of one family that are near, but not near enough, are not counted pair by pair.

Defined cases: a null or empty text has size 0 and its own id as component; texts of fewer than ``n`` words
have one n-gram, the whole text; rows are nodes of their own: rows of one id with different texts are not
joined by the id; a null id is left out when the smallest id of a component is taken (null if all are).
Input columns stay, except that columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.common import U64
from marketflow.llm.components import components

N = 5
NUM, DEN = 75, 100
FRAGMENTS = 8
#: Screen: n-grams whose hash modulo 8 is below this are counted (3/8 of all, whatever the input).
SCREENED = 3
#: Screened n-grams in one bucket of the shuffle.
BUCKET_GRAMS = 2_000_000
#: Leading n-grams (of its prefix, those that another set has too) by which a set looks for first candidates.
LEADING = 16
#: Rounds of first candidates end when fewer than one set in so many found a link, or after ROUNDS.
FEW, ROUNDS = 50, 6
#: Candidates that a set proposes in a round, and sets by hash that an n-gram offers.
PROPOSED, OFFERED = 3, 3
#: Bits of a set's parity bitmap, and its columns.
BITS = 256
#: Bits of the wide parity bitmap that the candidates meet before their overlaps are counted.
WIDE = 2048
MAP = ("m0", "m1", "m2", "m3")
COLUMNS = ("n_shingles", "component_id")
_LAST = (1 << 63) - 1


class Sets:
    """Sorted distinct n-gram hashes of the texts of a slice (``part``: only the screened ones)."""

    def __init__(self, texts: pa.Array, n: int, screened: bool = False):
        words = common.Words(texts, lower=True)
        at, doc = words.window_starts(n)
        grams = words.grams(n)[at]
        count = words.counts
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            start = words.doc[:-1][short]
            doc = np.concatenate([doc, short])
            grams = np.concatenate([grams, common.span_hash(words.hash, start, start + count[short])])
            order = np.argsort(doc, kind="stable")
            doc, grams = doc[order], grams[order]
        if screened:
            keep = (grams & U64(7)) < U64(SCREENED)
            doc, grams = doc[keep], grams[keep]
        off = np.searchsorted(doc, np.arange(len(count) + 1))
        grams = grams.copy()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        self.doc, self.grams = doc[new], grams[new]
        self.off = np.searchsorted(self.doc, np.arange(len(count) + 1))
        self.size = np.diff(self.off)

    def bitmaps(self, bits: int = BITS) -> np.ndarray:
        """Parity of the n-grams on each of the bits, as long columns."""
        n = len(self.size)
        bit = ((self.grams >> U64(8)) & U64(bits - 1)).astype(np.int64)
        parity = np.bincount(self.doc * bits + bit, minlength=n * bits).reshape(n, bits) & 1
        return np.packbits(parity.astype(bool), axis=1).view(np.int64)

    def key(self, salt: int) -> np.ndarray:
        total = np.zeros(len(self.grams) + 1, U64)
        np.cumsum(common.mix(self.grams ^ U64(salt)), out=total[1:])
        return common.mix(total[self.off[1:]] - total[self.off[:-1]]).view(np.int64)


def _sized(docs: DataFrame, n: int) -> DataFrame:
    """(doc, th, n, k1, k2): size and 128-bit key of each document's set."""

    def run(batches):
        for piece in common.slices(batches):
            sets = Sets(piece.column(2), n)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(sets.size, pa.int64()), pa.array(sets.key(1)), pa.array(sets.key(2))],
                names=["doc", "th", "n", "k1", "k2"])

    return docs.mapInArrow(common.lean(run), "doc bigint, th binary, n bigint, k1 bigint, k2 bigint")


def _own_counts(docs: DataFrame, sized: DataFrame, n: int) -> DataFrame:
    """(k1, own): how many screened n-grams no other set has. An n-gram travels as 6 bytes; two that agree
    in these count as shared, which keeps a set, never loses one."""
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(total * SCREENED / 8 // BUCKET_GRAMS + 16)

    def send(batches):
        for piece in common.merged_slices(batches):
            whole = Sets(piece.column(2), n)
            key = whole.key(1)
            part = (whole.grams & U64(7)) < U64(SCREENED)
            gram, owner = whole.grams[part] >> U64(16), key[whole.doc[part]]
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            first = np.ones(len(gram), bool)
            first[1:] = gram[1:] != gram[:-1]
            begin = np.flatnonzero(first)
            if not len(begin):
                continue
            low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
            gram, owner = gram[begin], np.where(low == high, low, 0)
            bucket = (gram % U64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            gram, owner, bucket = gram[order], owner[order], bucket[order]
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                a, z = cut[b], cut[b + 1]
                names, counts = np.unique(owner[a:z], return_counts=True)
                six = np.ascontiguousarray(gram[a:z]).view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((b, names.tobytes(), counts.astype(np.uint32).tobytes(), six.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
                names=["bucket", "owners", "counts", "grams"])

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, owners, counts, six in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append((owners, counts, six))
        for parts in held.values():
            owner = np.concatenate([np.repeat(np.frombuffer(o, np.int64), np.frombuffer(c, np.uint32)) for o, c, _ in parts])
            raw = np.frombuffer(b"".join(s for _, _, s in parts), np.uint8).reshape(-1, 6)
            wide = np.zeros((len(raw), 8), np.uint8)
            wide[:, :6] = raw
            gram = wide.view(np.uint64).ravel()
            order = np.argsort(gram, kind="stable")
            gram, owner = gram[order], owner[order]
            begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            low, high = np.minimum.reduceat(owner, begin), np.maximum.reduceat(owner, begin)
            own, n_own = np.unique(low[(low == high) & (low != 0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n_own, pa.int64())], names=["k1", "own"])

    sent = docs.mapInArrow(common.lean(send), "bucket bigint, owners binary, counts binary, grams binary")
    dealt = sent.repartition(buckets, "bucket")
    return dealt.mapInArrow(common.lean(count), "k1 bigint, own bigint").groupBy("k1").agg(F.sum("own").alias("own"))


def _survivors(docs: DataFrame, kept: DataFrame, n: int) -> DataFrame:
    """(sid, k1, k2, rep, n, own, m0..m3, wide, grams): the sets that may have a link, from the text of their first document."""

    def run(batches):
        for piece in common.slices(batches):
            sets = Sets(piece.column(2), n)
            right = np.flatnonzero(sets.key(1) == piece.column(4).to_numpy())
            offsets = pa.array(sets.off, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(sets.grams.view(np.int64)))
            pick, maps, wide = pa.array(right), sets.bitmaps()[right], sets.bitmaps(WIDE)[right]
            wide = pa.ListArray.from_arrays(pa.array(np.arange(len(right) + 1) * wide.shape[1], pa.int32()), pa.array(wide.ravel()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(4).take(pick), piece.column(6).take(pick), piece.column(3).take(pick), pa.array(sets.size[right], pa.int64()),
                 piece.column(5).take(pick), *(pa.array(np.ascontiguousarray(maps[:, k])) for k in range(4)), wide, lists.take(pick)],
                names=["k1", "k2", "rep", "n", "own", *MAP, "wide", "grams"])

    names = ["doc", "th", "text", "rep", "k1", "own", "k2"]
    # equal rows are one: the join has brought them together
    rows = docs.join(kept.select("doc", "th", "rep", "k1", "own", "k2"), ["doc", "th"]).dropDuplicates(["doc", "th"]).select(names)
    found = rows.mapInArrow(common.lean(run), "k1 bigint, k2 bigint, rep bigint, n bigint, own bigint, m0 bigint, m1 bigint, m2 bigint, "
                            "m3 bigint, wide array<bigint>, grams array<bigint>")
    return found.where("n > 0").withColumn("sid", F.monotonically_increasing_id()).select(
        "sid", "k1", "k2", "rep", "n", "own", *MAP, "wide", "grams")


def _ordered(classes: np.ndarray, grams: np.ndarray, off: np.ndarray):
    """Grams of each set in the global order, with their classes."""
    kind = classes[common.cell_of(grams.view(U64))].astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    hot = kind > 0
    if hot.any():
        order = np.lexsort((grams.view(U64), kind, doc))
        grams, kind = grams[order], kind[order]
    return grams, kind, doc


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets (from 0) of a list column."""
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[off[0]:off[-1]], off - off[0]


def _fragments(sets: DataFrame, classes) -> DataFrame:
    """(sid, n, frag, grams): every set cut along the global order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, off = _lists(batch.column(2))
            grams, kind, doc = _ordered(classes.value, grams, off)
            frag = np.where(kind > 0, FRAGMENTS - 1, ((grams.view(U64) >> U64(32)) * U64(FRAGMENTS - 1) >> U64(32)).astype(np.int64))
            order = np.lexsort((frag, doc))
            code = (doc * FRAGMENTS + frag)[order]
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(code)), pa.int32()), pa.array(grams[order]))
            pick = pa.array(code[begin] // FRAGMENTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array((code[begin] % FRAGMENTS).astype(np.int32)), lists],
                names=["sid", "n", "frag", "grams"])

    return sets.select("sid", "n", "grams").mapInArrow(common.lean(run), "sid bigint, n bigint, frag int, grams array<bigint>")


def _prefixes(sets: DataFrame, classes) -> DataFrame:
    """(gram, sid, n, pos): n-grams of the prefixes, with their place in the set's order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            grams, off = _lists(batch.column(2))
            grams, _, doc = _ordered(classes.value, grams, off)
            size = np.diff(off)
            prefix = size - (NUM * size + DEN - 1) // DEN + 1
            pos = np.arange(len(grams)) - off[:-1][doc]
            keep = np.flatnonzero(pos < prefix[doc])
            pick = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams[keep]), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(pos[keep].astype(np.int32))],
                names=["gram", "sid", "n", "pos"])

    return sets.select("sid", "n", "grams").mapInArrow(common.lean(run), "gram bigint, sid bigint, n bigint, pos int")


def _partial(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b, na, nb, both, miss): overlap of pairs inside the given fragments, and how many n-grams of a there
    are not in b, summed over the fragments."""
    left = fragments.select(F.col("sid").alias("a"), "frag", F.col("grams").alias("ga"))
    right = fragments.select(F.col("sid").alias("b"), "frag", F.col("grams").alias("gb"))
    both = F.coalesce(F.size(F.array_intersect("ga", "gb")), F.lit(0))
    # a set may have nothing in these fragments: its pairs stay, with counts of 0
    counted = pairs.join(left, "a", "left").join(right, ["b", "frag"], "left").select(
        "a", "b", "na", "nb", both.alias("both"), (F.coalesce(F.size("ga"), F.lit(0)) - both).alias("miss"))
    return counted.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"), F.sum("miss").alias("miss"))


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) whose wide bitmaps differ in no more bits than those of a link can."""
    of_a, of_b = (sets.select(F.col("sid").alias(x), F.col("wide").alias("w" + x)) for x in "ab")
    bits = "aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    return pairs.join(of_a, "a").join(of_b, "b").where(f"{bits} <= {_room('na', 'nb')}").select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, sets: DataFrame, fragments: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that are links, as (a, b): overlaps are counted fragment by fragment and summed
    per pair; pairs that miss too much in the first two fragments need no more of them."""
    least = f"ceil({NUM} * (na + nb) / {DEN + NUM})"
    first = common.written(_partial(_near(pairs, sets), fragments.where("frag < 2")).where(f"na - miss >= {least}"), "pairs")
    rest = _partial(first.select("a", "b", "na", "nb"), fragments.where("frag >= 2"))
    total = first.select("a", "b", "na", "nb", "both").unionByName(rest.select("a", "b", "na", "nb", "both"))
    return total.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both")).where(
        f"{DEN} * both >= {NUM} * (na + nb - both)").select("a", "b")


def _room(na: str, nb: str) -> str:
    """SQL of the most n-grams of two sets that can be in one only, if they are linked."""
    return f"{na} + {nb} - 2 * ceil({NUM} * ({na} + {nb}) / {DEN + NUM})"


def _distance(a: str, b: str) -> str:
    """SQL of the bits in which two bitmaps differ: at most the n-grams that are in one set only."""
    return " + ".join(f"bit_count({a}{m} ^ {b}{m})" for m in MAP)


def _bounds(a: str, b: str, na: str, nb: str) -> str:
    """SQL that holds for every link, from sizes and bitmaps."""
    return (f"{DEN} * least({na}, {nb}) >= {NUM} * greatest({na}, {nb}) AND "
            f"{_distance(a, b)} <= {_room(na, nb)}")


def _proposals(leading: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(a, b, na, nb): for each set the nearest candidates of other components that its leading n-grams offer."""
    rows = leading.join(labels, "sid")
    open_set = F.struct("sid", "n", "root", *MAP)
    offers = [F.min_by(open_set, F.struct("share", "rep", "sid")),
              *(F.min_by(open_set, F.xxhash64("sid", F.lit(OFFERED * k + j))) for j in range(OFFERED))]
    hubs = rows.groupBy("gram").agg(F.array_distinct(F.array(*offers)).alias("cs"), F.count("*").alias("c")).where("c > 1")
    pairs = rows.join(hubs.drop("c"), "gram").withColumn("c", F.explode("cs")).where(
        "root <> c.root AND " + _bounds("", "c.", "n", "c.n"))
    near = pairs.select("sid", "n", F.struct(F.expr(_distance("", "c.")).alias("d"), F.col("c.sid").alias("b"), F.col("c.n").alias("nb")).alias("c"))
    best = near.groupBy("sid", "n").agg(F.slice(F.array_sort(F.collect_set("c")), 1, PROPOSED).alias("cs"))
    return best.select(F.col("sid").alias("a"), "n", F.explode("cs").alias("c")).select(
        "a", F.col("c.b").alias("b"), F.col("n").alias("na"), F.col("c.nb").alias("nb"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (sid, root) after the links (a, b) have joined components."""
    of_a = links.join(labels.select(F.col("sid").alias("a"), F.col("root").alias("ra")), "a")
    ends = of_a.join(labels.select(F.col("sid").alias("b"), F.col("root").alias("rb")), "b")
    roots = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    new = labels.join(roots.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return common.written(new.select("sid", F.coalesce("top", "root").alias("root")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
                    keep_one: bool = False) -> DataFrame:
    """``docs`` plus n_shingles (size of the set) and component_id (smallest id of the component).

    ``keep_one``: only the component's first row by (id, 128-bit text key), one of them if the row is repeated."""
    spark = docs.sparkSession
    common.prepare(spark)
    doc, th = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)), common.text_key(F.col(text_col))
    slim = docs.select(doc.alias("doc"), th.alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = common.written(_sized(slim, n), "sized")
    classes_of = sized.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("doc", "th")).alias("f"))
    screened = common.written(classes_of.join(_own_counts(slim, sized, n), "k1", "left").select(
        F.col("f.doc").alias("doc"), F.col("f.th").alias("th"), F.col("f.doc").alias("rep"), "k1", "k2", "n",
        F.coalesce("own", F.lit(0)).alias("own")), "screened")
    alive = screened.where(f"own <= n - ceil({NUM} * n / {DEN})")
    sets = common.written(_survivors(slim, alive, n), "sets")

    def cells(batches):
        for batch in batches:
            yield common.cell_of(_lists(batch.column(0))[0].view(U64))

    counts = common.sketch(sets.select("grams"), cells)
    classes = spark.sparkContext.broadcast(common.hot_classes(counts))
    prefixes, fragments = _prefixes(sets, classes), _fragments(sets, classes)

    standing = sets.select("sid", (F.col("own") / F.col("n")).alias("share"), "rep", *MAP)
    twice = prefixes.groupBy("gram").count().where("count > 1").select("gram")
    prefixes = common.written(prefixes.join(twice, "gram", "left_semi"), "prefixes")
    place = F.row_number().over(Window.partitionBy("sid").orderBy("pos"))
    leading = prefixes.withColumn("place", place).where(F.col("place") <= LEADING).select("gram", "sid", "n")
    leading = common.written(leading.join(standing, "sid"), "leading")
    labels = common.written(sets.select("sid", F.col("sid").alias("root")), "labels")
    few = sets.count() // FEW
    for k in range(ROUNDS):
        found = common.written(_linked(_proposals(leading, labels, k), sets, fragments), "links")
        n_found = found.count()
        if n_found:
            labels = _merged(labels, found)
        if n_found <= few:
            break
    placed = common.written(prefixes.join(labels, "sid"), "placed")
    mixed = placed.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("gram")
    side = common.written(placed.join(mixed, "gram", "left_semi").join(sets.select("sid", *MAP), "sid"), "mixed")
    a, b = (side.select("gram", *(F.col(c).alias(x + c) for c in ("sid", "n", "pos", "root", *MAP))) for x in "ab")
    pairs = a.join(b, "gram").where("aroot < broot").where(_bounds("a", "b", "an", "bn")).where(
        f"{DEN + NUM} * least(an - apos, bn - bpos) >= {NUM} * (an + bn)").select(
        F.col("asid").alias("a"), F.col("bsid").alias("b"), F.col("an").alias("na"), F.col("bn").alias("nb"))
    across = common.written(pairs.distinct(), "across")
    labels = _merged(labels, common.written(_linked(across, sets, fragments), "links"))
    key = ["k1", "k2", "n"]
    of_set = screened.select(*key, F.struct("doc", "th").alias("first")).join(
        sets.select("sid", *key).join(labels, "sid").drop("sid"), key, "left")
    # written, so that the join by component can be split where one component holds many sets
    least = common.written(of_set.where("root IS NOT NULL").groupBy("root").agg(
        F.min("first").alias("__first"), F.count("*").alias("sets")).where("sets > 1").drop("sets"), "least")
    of_class = of_set.join(least, "root", "left").select(*key, F.coalesce("__first", "first").alias("__first"))
    of_row = sized.join(of_class, key, "left").groupBy("doc", "th").agg(F.min("n").alias("n_shingles"), F.min("__first").alias("__first"))
    out = docs.drop(*COLUMNS).withColumns({"__doc": doc, "__th": th}).join(
        of_row.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), "n_shingles", "__first"), ["__doc", "__th"], "left")
    own = F.coalesce(F.col("__first.doc"), F.col("__doc"))
    out = out.withColumn("component_id", F.when(own != _LAST, own))
    if keep_one:
        place = F.row_number().over(Window.partitionBy("__doc", "__th").orderBy("__doc"))
        itself = F.struct(F.col("__doc").alias("doc"), F.col("__th").alias("th"))
        out = out.where(F.coalesce(F.col("__first") == itself, F.lit(True))).withColumn("__place", place)
        out = out.where("__place = 1").drop("__place")
    return out.drop("__doc", "__th", "__first")
