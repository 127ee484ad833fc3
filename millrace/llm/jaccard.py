"""Exact Jaccard join of documents on word shingles, as components of linked documents."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.plans.skew import salted_join
from millrace.session import ship, shuffles_removed, written

WORDS = 5  # of a shingle
SHARE = 80  # percent: 100 * intersection >= SHARE * union
TILE = 1_024  # documents on a side of a tile
SPREAD = 8  # tasks among which groups of the same documents are dealt
NAMED = 1 << 18  # pairs that a task remembers having named; those beyond are merged afterwards
MEMBERS = 512  # documents that are compared with one centre in a task
PIECE = 1 << 20  # bytes of a text that are hashed at once
STARS = (1, 8)  # centres of a band that its documents are compared with, in rounds
ROUNDS = 4  # parts of the shingles that are shuffled one after another
MARKED = 1 << 23  # dropped ids that a bitmap may stand for
MARK_BITS = 16  # of it for each of them, at least
BANDS, ROWS = 4, 4  # least hashes whose agreement makes two documents worth a first look

_POWER = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values (A-Z as a-z), blanks, and the powers of the running hash with their inverses."""
    byte = np.arange(256)
    byte[65:91] += 32
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    ones = lambda p: np.cumprod(np.concatenate(([np.uint64(1)], np.full(PIECE, p))))
    return _mix(byte.astype(np.uint64) + np.uint64(1)), blank, ones(_POWER), ones(_BACK)


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, whatever its place."""
    value, blank_of, power, back = _tables()
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    blank = blank_of[data]
    found, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            cut = PIECE - int(blank[at:end][::-1].argmax()) if blank[at:end].any() else PIECE
            end = at + cut
        edge = np.diff(np.concatenate(([True], blank[at:end], [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate(([np.uint64(0)], np.cumsum(value[data[at:end]] * power[: end - at])))
        found.append(_mix((total[ends] - total[starts]) * back[starts]))
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of the whole sequence if it is shorter; none without words.

    Words lie between blanks, with A-Z lower-cased. A word of over a million bytes is hashed in parts.
    """
    h = _word_hashes(text or "")
    if not len(h):
        return np.empty(0, np.int64)
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _NEXT + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out).view(np.int64))


def _width(n: int) -> int:
    """Bits of a signature for ``n`` shingles: a power of two from 4 * n up to 2048, from ``n`` beyond."""
    return max(64, min(2_048, 1 << (4 * n - 1).bit_length()), 1 << (n - 1).bit_length())


def signature(hashes: np.ndarray) -> bytes:
    """Bitmap of the hashes modulo its width."""
    width = _width(len(hashes))
    bits = np.zeros(width, np.uint8)
    bits[hashes & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def prefix_size(n: int, share: int = SHARE) -> int:
    """So many least shingles of a set hold one of any set linked to it, as links leave at most the others out."""
    return n - -(-share * n // 100) + 1


@functools.cache
def _seeds() -> np.ndarray:
    return _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def _band_keys(hashes: np.ndarray) -> list[int]:
    h = hashes.view(np.uint64)
    least = np.array([_mix(h ^ s).min() for s in _seeds()]).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix(key * _NEXT + least[:, r])
    return key.view(np.int64).tolist()


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _profiles(docs: DataFrame, words: int, share: int) -> DataFrame:
    """A row per document: set size and key, least shingles, bitmap, band keys. Whole texts, no shuffle."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingle_hashes(text, words)
                if len(h):
                    rows.append((doc_id, len(h), _set_key(h), h[: prefix_size(len(h), share)], signature(h), _band_keys(h)))
                else:
                    rows.append((doc_id, 0, None, None, None, None))
            types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                names=["doc_id", "n", "key", "least", "bits", "bands"],
            )

    schema = "doc_id long, n long, key binary, least array<long>, bits binary, bands array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """``key, hashes`` of documents with words."""

    def run(batches):
        for batch in batches:
            made = [h for h in (shingle_hashes(t, words) for t in batch.column(0).to_pylist()) if len(h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(h) for h in made], pa.binary()), pa.array([h.tobytes() for h in made], pa.large_binary())],
                names=["key", "hashes"],
            )

    return docs.select("text").mapInArrow(run, "key binary, hashes binary")


def _groups(batches, columns: int):
    """Runs of rows with equal first ``columns`` values of a sorted stream, as lists of rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:columns] != row[:columns]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Exact intersection of two sorted arrays against the share of their union."""
    where = np.searchsorted(a, b)
    common = int((a[np.minimum(where, len(a) - 1)] == b).sum())
    return 100 * common >= share * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, share: int) -> DataFrame:
    """Pairs (``a, b``) of classes whose sets are really linked.

    The sets are made again, for the classes named alone. Each set goes to where its pairs are: the centre ``a``
    once per task that compares, the members ``b`` one by one; a centre of many members is spread over tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    members = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.lit(1).alias("side"), F.col("b").alias("c"))
    centres = many.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).select("a", "part", F.lit(0).alias("side"), F.col("a").alias("c"))
    wanted = members.unionAll(centres)
    ids = written(wanted.join(classes.select("c", "key", "first_id"), "c"), "wanted")
    texts = docs.select(F.col("doc_id").alias("first_id"), "text")
    chosen = ids.select("first_id").distinct()
    texts = texts.join(chosen, texts["first_id"].eqNullSafe(chosen["first_id"]), "left_semi")
    rows = _sets(texts, words).join(ids, "key").select("a", "part", "side", "c", "hashes")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compare(batches):
        now, centre = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                a, part, side, c = (batch.column(k)[i].as_py() for k in range(4))
                h = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
                if side == 0:
                    now, centre = (a, part), h.copy()
                elif now == (a, part) and _linked(centre, h, share):
                    out.append((a, c))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["a", "b"]
            )

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _star_pairs(looked: DataFrame, labels: DataFrame, stars: int) -> DataFrame:
    """Pairs of a class with up to ``stars`` centres of each of its bands, where no link joins them yet.

    Centres are the least by as many hashes, and looked for in bands of several components alone.
    """
    known = looked.join(labels, looked["c"] == labels["node"], "left")
    known = known.select("band", "c", F.coalesce("component", "c").alias("component"))
    least = [F.min(F.struct(F.xxhash64("c", F.lit(k)), "c", "component")).alias(f"s{k}") for k in range(stars)]
    # Two numbers of a band are sent to tell; its centres are some 400 bytes.
    several = known.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    bands = known.join(several.select("band"), "band").groupBy("band").agg(*least)
    bands = bands.select("band", F.explode(F.array_distinct(F.array(*(f"s{k}" for k in range(stars))))).alias("s"))
    met = known.join(bands, "band").where("s.component != component")
    return met.select(F.least("c", "s.c").alias("b"), F.greatest("c", "s.c").alias("a")).select("a", "b").distinct()


def _tile_pairs(rows: list[tuple], share: int):
    """Pairs of a tile that may be linked: size and common bits allow it, and no link joins them yet.

    ``rows`` are (sig, i, j, part, c, n, component, bits, at). A bit that one bitmap has and the other lacks stands
    for a shingle at least that the other lacks, which bounds the intersection from above. So does the place ``at``
    of the shingle by which they meet: where it is the first in common, nothing before it is, and a pair whose first
    is another meets by that one as well.
    """
    rows.sort(key=lambda r: (r[5], r[4]))
    i, j = rows[0][1], rows[0][2]
    part, c, n, comp, at = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5, 6, 8))
    if comp.min() == comp.max():
        return
    widths = np.array([8 * len(r[7]) for r in rows])
    folded = {}
    for width in np.unique(widths):
        some = np.flatnonzero((widths == width) | (widths == 2 * width))
        matrix = np.zeros((len(some), width // 64), np.uint64)
        for k, r in enumerate(some):
            bits = np.frombuffer(rows[r][7], np.uint64)
            matrix[k] = bits if widths[r] == width else bits[: width // 64] | bits[width // 64 :]
        folded[int(width)] = (int(some[0]), matrix)
    last = np.searchsorted(n, 100 * n // share, "right")
    for x in range(len(rows)):
        others = np.arange(x + 1, last[x])
        keep = comp[others] != comp[x]
        if i != j:
            keep &= part[others] != part[x]
        rest = np.minimum(n[x] - at[x], n[others] - at[others])
        keep &= 100 * rest >= share * (n[x] + n[others] - rest)
        others = others[keep]
        if not len(others):
            continue
        first, matrix = folded[int(widths[x])]
        mine, theirs = matrix[x - first], matrix[others - first]
        lack = np.bitwise_count(mine & ~theirs).sum(1, dtype=np.int64)
        more = np.bitwise_count(theirs & ~mine).sum(1, dtype=np.int64)
        most = np.minimum(n[x] - lack, n[others] - more)
        for y in others[100 * most >= share * (n[x] + n[others] - most)]:
            yield int(min(c[x], c[y])), int(max(c[x], c[y]))


def _meetings(known: DataFrame, profiles: DataFrame, share: int, part: int) -> DataFrame:
    """Documents (``sig, size, c, at, n, component, lead``) of groups that meet by shingles of one of ``ROUNDS`` parts.

    Where a shingle is the first that two sets have in common, its places in them bound the intersection, as in
    :func:`_tile_pairs`. ``most`` is so the size of the largest set that a document can be linked with by it. A row
    stays if a smaller set may reach its size, or the next larger one is in its own reach; in a group of two, both
    sizes have to be in reach.
    """
    mine = lambda s: F.pmod(s, F.lit(ROUNDS)) == part
    places = F.filter(F.sequence(F.lit(0), F.size("least") - 1), lambda i: mine(F.get("least", i)))
    least = profiles.where("least is not null").select(F.col("row").alias("c"), places.alias("places"), F.filter("least", mine).alias("least"))
    postings = least.join(known, "c").select("c", "n", "component", "places", F.posexplode("least").alias("i", "shingle"))
    postings = postings.select("c", "n", "component", F.get("places", "i").alias("at"), "shingle")
    most = F.expr(f"{100 + share} * (n - at) div {share} - n")
    by_size = Window.partitionBy("shingle").orderBy("n")
    whole = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = postings.withColumn("most", most).withColumns(
        {
            "lo": F.min("component").over(whole),
            "hi": F.max("component").over(whole),
            "size": F.count(F.lit(1)).over(whole),
            "sig": F.bit_xor(F.xxhash64("c")).over(whole),
            "lead": F.min("c").over(whole),
            "below": F.lag("n").over(by_size),
            "above": F.lead("n").over(by_size),
            "reach": F.max("most").over(by_size.rowsBetween(Window.unboundedPreceding, -1)),
            "back": F.lead("most").over(by_size),
        }
    )
    smaller = "reach >= n and (size > 2 or most >= below)"
    larger = "most >= above and (size > 2 or back >= n)"
    met = met.where(f"lo != hi and ({smaller} or {larger})")
    return met.groupBy("sig", "size", "c").agg(F.min("at").alias("at"), *(F.first(k).alias(k) for k in ("n", "component", "lead")))


def _candidates(classes: DataFrame, profiles: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """Pairs of classes in different components that sizes and bitmaps don't rule out.

    Linked sets share one of their least shingles, so documents meet by those. Shingles with the same documents
    are one group; a group inside one component is done with, and so is a document that none of a group may be linked
    with (:func:`_meetings`, for a part of the shingles at a time, which bounds the disk). Groups are cut by set size into bands of ``TILE`` documents, and bands whose
    sizes are compatible meet as tiles. Bitmaps join their documents in the tiles alone.
    """
    known = classes.join(labels, classes["c"] == labels["node"], "left")
    known = known.select("c", "n", F.coalesce("component", "c").alias("component"))
    met = [written(_meetings(known, profiles, share, r), "groups") for r in range(ROUNDS)]
    met = functools.reduce(DataFrame.unionAll, met).groupBy("sig", "size", "c").agg(
        F.min("at").alias("at"), *(F.first(k).alias(k) for k in ("n", "component", "lead"))
    )
    # The rank in a group decides nothing but the cut into bands.
    rank = F.row_number().over(Window.partitionBy("sig", "size").orderBy("n", "c"))
    banded = met.withColumn("part", F.when(F.col("size") > TILE, F.floor((rank - 1) / TILE)).otherwise(0))
    banded = written(banded, "bands")
    bands = banded.groupBy("sig", "size", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = bands.select("sig", "size", F.col("part").alias("i"), "high")
    right = bands.select("sig", "size", F.col("part").alias("j"), "low")
    tiles = left.join(right, ["sig", "size"]).where(F.expr(f"i <= j and 100 * high >= {share} * low"))
    sides = tiles.select("sig", "size", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    rows = banded.join(sides, ["sig", "size", "part"]).join(profiles.select(F.col("row").alias("c"), "bits"), "c")
    rows = rows.select(F.xxhash64("sig", "size").alias("sig"), "i", "j", "part", "c", "n", "component", "bits", "at", "lead")
    # Groups of the same documents lie together, so that a task names most pairs once.
    rows = rows.repartition("lead", "i", "j", F.pmod("sig", F.lit(SPREAD))).drop("lead").sortWithinPartitions("sig", "i", "j")

    def run(batches):
        named: set[tuple[int, int]] = set()
        for group in _groups(batches, 3):
            pairs = list(set(_tile_pairs(group, share)) - named)
            named = set() if len(named) > NAMED else named
            named.update(pairs)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of at least ``share`` percent: ``doc_id, n_shingles, component_id``.

    A document's set is its distinct shingles of ``words`` words (A-Z lower-cased), or its whole sequence if it is
    shorter. One row per row of ``docs``, with the size of its set and the least ``doc_id`` that links reach. No
    link between different texts is lost:

    1. Documents of equal sets form a class, which goes on as one.
    2. Classes that agree on a band of least hashes are compared with the least of them; true links already join
       most near copies, without pairs among copies.
    3. Classes of different components that share one of their least shingles meet in size-banded tiles; bitmaps
       bound the intersection from above, and what passes is compared exactly.
    4. Components of all links.

    Null, empty and blank texts have 0 shingles and are their own component. Repeated rows are a class. Null ids
    never name a component that has another id. Extra columns are ignored; an empty table gives no rows. Sets are
    64-bit hashes of shingles. Texts are read three times at most, twice for documents that may be linked alone.
    """
    ship(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        return _components(docs, words, share)


def _components(docs: DataFrame, words: int, share: int) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = written(_profiles(docs, words, share).withColumn("row", F.monotonically_increasing_id()), "profiles")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n")
    classes = rows.where("n > 0").groupBy("key").agg(F.min(order).alias("first"))
    classes = classes.select("key", F.col("first.row").alias("c"), F.col("first.doc_id").alias("first_id"), F.col("first.n").alias("n"))
    classes = written(classes, "classes")

    looked = rows.select(F.col("row").alias("c"), F.explode("bands").alias("band")).join(classes.select("c"), "c")
    labels = written(classes.limit(0).select(F.col("c").alias("node"), F.col("c").alias("component")), "labels")
    for stars in STARS:
        near = written(_star_pairs(looked, labels, stars), "near")
        links = _verified(near, classes, docs, words, share)
        labels = written(components(links.unionAll(labels.toDF("a", "b"))), "labels")

    pairs = written(_candidates(classes, rows, labels, share), "pairs")
    links = _verified(pairs, classes, docs, words, share)
    top = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_top"))
    links = links.join(top("a"), "a", "left").join(top("b"), "b", "left")
    links = links.select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b"))
    joined = written(components(links), "labels")

    final = classes.select("c", "key", "first_id").join(labels, F.col("c") == labels["node"], "left")
    final = final.select("key", "first_id", F.coalesce("component", "c").alias("c1"))
    final = final.join(joined, final["c1"] == joined["node"], "left").select("key", "first_id", F.coalesce("component", "c1").alias("c"))
    final = written(final, "final")
    names = final.groupBy("c").agg(F.min("first_id").alias("component_id"))
    named = final.join(names, "c").select("key", "component_id")
    out = salted_join(rows.where("n > 0").select("doc_id", "n", "key", "row"), named, "key", "row")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(rows.where("n = 0").select("doc_id", F.col("n"), F.col("doc_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each component, that of the least ``doc_id``.

    Rows that repeat a kept id give one row. Rows without an id can't be told apart and stay, all of them.
    """
    found = jaccard_components(docs, words, share)
    rows = F.sum(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("long")).alias("rows")
    verdicts = written(found.where("doc_id is not null").groupBy("doc_id").agg(rows), "verdicts")
    chosen = _kept(docs, verdicts).select(*docs.columns)
    if verdicts.where("rows > 1").limit(1).count():
        chosen = chosen.dropDuplicates(["doc_id"])
    return chosen.unionAll(docs.where("doc_id is null"))


def _kept(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id has ``rows`` in ``verdicts`` (``doc_id, rows``, which has every id); no text is shuffled.

    Each dropped id sets two bits of a bitmap, which is sent with the kept ids that happen to have both set (one or
    two in a hundred): a row stays if a bit is missing, or its id is one of those. More than ``MARKED`` dropped ids
    are left out by a join, which shuffles the texts.
    """
    kept, dropped = verdicts.where("rows > 0").select("doc_id"), verdicts.where("rows = 0").select("doc_id")
    n = dropped.count()
    if n > MARKED:
        return docs.join(kept, "doc_id", "left_semi")
    size = max(64, 1 << (MARK_BITS * n - 1).bit_length()) if n else 64
    places = [F.pmod(F.xxhash64(F.col("doc_id").cast("bigint"), F.lit(k)), F.lit(size)) for k in range(2)]
    bits = dropped.select(F.explode(F.array(*places)).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
    filled = bits.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(size // 64, np.int64)
    bitmap[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def marked(a: pd.Series, b: pd.Series) -> pd.Series:
        has = [(shared.value[x >> 6] >> (x & 63)) & 1 for x in (a.to_numpy(), b.to_numpy())]
        return pd.Series((has[0] & has[1]).astype(bool))

    doubted = kept.where(marked(*places)).withColumn("_kept", F.lit(True))
    rows = docs.where("doc_id is not null").withColumn("_marked", marked(*places))
    return rows.join(F.broadcast(doubted), "doc_id", "left").where("not _marked or _kept")
