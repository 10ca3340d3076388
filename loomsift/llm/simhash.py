"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits.  Two fingerprints that differ in at most
three bits differ in at most one bit of some segment, so every fingerprint is filed
under both segments and looked up under every value within one bit of its own; complete
distances are verified in the join.  One-bit neighbours have different parity, so only
values of odd parity enumerate their ball, and each pair meets once in each segment.
Equal fingerprints are one entry throughout, however many documents share them.

The pipeline's stage goes on from these classes: wider signatures of the same shingles
are enumerated in the same way, and 5-word shingles decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsift.llm.common import arrow_rows, doc_texts, documents, give_back, row_hash, written
from loomsift.llm.graph import components

WORDS = 3
SEED = 42
DISTANCE = 3
#: Buckets with more fingerprints are looked up by a further part of the fingerprint.
HOT = 4096
#: The pipeline's stage: further segments and their bits, bits that may differ (of the fingerprint and the three
#: segments after the one that met), sketch size, least similarity.
SEGMENTS, SEGMENT_BITS = 13, 24
WIDE_DISTANCE = 26
SKETCH = 256
SIMILAR = 0.8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of every 3-word shingle, repeats included; of fewer words the whole sequence."""
    import xxhash

    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        hashes = [hash_of(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-WORDS] + 1).tolist()]
        hashes = [hash_of(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1:].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def fingerprint(text: str) -> int:
    """64-bit fingerprint: a bit is set where over half of the shingle hashes have it."""
    hashes = shingle_hashes(text)
    return int.from_bytes(np.packbits(_majority(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (signed 64 bit) of every document."""
    def rows(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            value = fingerprint(text)
            yield doc_id, value - (value >> 63 << 64)

    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    return doc_texts(docs).mapInArrow(arrow_rows(rows, schema), "doc_id long, fp long")


def _segments(fps: DataFrame) -> DataFrame:
    """seg, value (32 bit) and rest (the other 32 bits) of each fingerprint."""
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), low.alias("value"), high.alias("rest")),
        F.struct(F.lit(1).alias("seg"), high.alias("value"), low.alias("rest")))).alias("s")).select("fp", "s.*")


def _split(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries of hot buckets once for each byte of the rest, with that byte; the others once, with -1.

    At most three bits of the rest differ, so one of its four bytes is equal.
    """
    bytes_ = F.array(*(F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("rest", 8 * j).bitwiseAND(255).alias("byte")) for j in range(4)))
    none = F.array(F.struct(F.lit(-1).alias("j"), F.lit(-1).cast("long").alias("byte")))
    return (entries.join(hot, ["seg", "value"], "left").withColumn("k", F.explode(F.when(F.col("hot"), bytes_).otherwise(none)))
            .select("seg", "value", "k.j", "k.byte", "fp"))


def near_pairs(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs ``a``, ``b`` of distinct fingerprints that differ in at most three bits.

    ``fps`` holds each fingerprint once, in column ``fp``.
    """
    table = _segments(fps)
    odd = F.bit_count("value") % 2 == 1
    ball = F.when(odd, F.array(*(F.lit(v).cast("long") for v in (0, *(1 << i for i in range(32)))))).otherwise(F.array(F.lit(0).cast("long")))
    probes = table.withColumn("flip", F.explode(ball)).select("seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "rest", "fp")
    keys = ["seg", "value"]
    crowded = written(table.groupBy("seg", "value").agg(F.count("*").alias("n")).where(F.col("n") > hot)
                      .select("seg", "value", F.lit(True).alias("hot")), "hot-buckets")
    if crowded.limit(1).count():
        table, probes, keys = _split(table, crowded), _split(probes, crowded), ["seg", "value", "j", "byte"]
    t, p = table.select(*keys, F.col("fp").alias("t")), probes.select(*keys, F.col("fp").alias("p"))
    same = [t[k] == p[k] for k in keys]
    near = F.bit_count(F.col("t").bitwiseXOR(F.col("p"))).between(1, DISTANCE)
    # Sizes of exploded tables are not known beforehand: neither side may be broadcast.
    found = t.hint("merge").join(p, [*same, near])
    return found.select(F.least("t", "p").alias("a"), F.greatest("t", "p").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    ``component_id`` is the smallest doc_id reachable over links.  Texts without words
    (null, empty) have fingerprint zero and link like any others.  Rows with a null
    doc_id get the component of their fingerprint but lead none (null if no document
    with a doc_id has it).  An empty table gives no rows.
    """
    prints = written(fingerprints(docs), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    pairs = near_pairs(distinct.select("fp"))
    # Over fingerprints, so one held only by rows without a doc_id still links others.
    groups = distinct.join(components(pairs), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = groups.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- the stage of the pipeline ---------------------------------------------------

def _mixed(x: np.ndarray, turn: int) -> np.ndarray:
    """Further hashes from hashes (splitmix finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * turn & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits, from the lowest, that over half of the 64-bit hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[i:i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return ones * 2 > len(hashes)


def signature(text: str) -> tuple[int, list[int], np.ndarray]:
    """The fingerprint, ``SEGMENTS`` further segments of ``SEGMENT_BITS``, and a sketch of the 5-word shingles.

    The further bits are majorities like those of the fingerprint, over hashes mixed from
    the same shingles' hashes.  The sketch holds the ``SKETCH`` least 32-bit hashes of
    the distinct 5-word shingles (all of them where there are no more).
    """
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0, [0] * SEGMENTS, np.empty(0, "<u4")
    fp = int.from_bytes(np.packbits(_majority(hashes), bitorder="little").tobytes(), "little")
    bits = np.concatenate([_majority(_mixed(hashes, turn)) for turn in range(1, -(-SEGMENTS * SEGMENT_BITS // 64) + 1)])
    segments = bits[:SEGMENTS * SEGMENT_BITS].reshape(SEGMENTS, SEGMENT_BITS) @ (1 << np.arange(SEGMENT_BITS))
    # Shingles of three words that start two words apart make one of five.
    long = _mixed(hashes[:-2] * np.uint64(0xD6E8FEB86659FD93) + hashes[2:], 99) if len(hashes) > 2 else _mixed(hashes[:1], 98 + len(hashes))
    return fp, segments.tolist(), np.unique(long >> np.uint64(32))[:SKETCH].astype("<u4")


def similarity(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard similarity of two shingle sets from their sketches; exact for sets that fit."""
    both = np.union1d(a, b)
    if len(a) >= size or len(b) >= size:
        both = both[:size]
    return len(np.intersect1d(np.intersect1d(a, b), both)) / len(both) if len(both) else 1.0


def _signatures(docs: DataFrame) -> DataFrame:
    """no_id, id, key (hash of the text), fp, segments and sketch of every row."""
    def rows(batch):
        give_back()
        for no_id, i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fp, segments, sketch = signature(text)
            yield no_id, i, key, fp - (fp >> 63 << 64), segments, sketch.tobytes()

    schema = pa.schema([("no_id", pa.bool_()), ("id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("segments", pa.list_(pa.int32())), ("sketch", pa.binary())])
    return (docs.select(*_row_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .mapInArrow(arrow_rows(rows, schema), "no_id boolean, id long, key long, fp long, segments array<int>, sketch binary"))


def _row_key() -> list:
    """What names a row: its doc_id (a null one apart from all others) and a hash of its text."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNull().alias("no_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("key")]


def _buckets(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """seg, value, class, fp and more: one entry for each class in each bucket, however many of its fingerprints fall there.

    ``more`` holds bits of the segments after ``seg``, to judge distances by beside the fingerprint.
    """
    around = F.concat("segments", "segments")
    after = [F.get(around, F.col("seg") + k).cast("long") for k in (1, 2, 3)]
    # 64 of their 72 bits: the third is shifted out of the long in part.
    bits = after[0].bitwiseOR(F.shiftleft(after[1], SEGMENT_BITS)).bitwiseOR(F.shiftleft(after[2], 2 * SEGMENT_BITS))
    spread_ = (prints.select("fp", "segments", F.posexplode("segments").alias("seg", "value")).select("fp", "seg", "value", bits.alias("more"))
               .distinct().join(classes, "fp"))
    return written(spread_.groupBy("seg", "value", "class").agg(F.min("fp").alias("fp"), F.min_by("more", "fp").alias("more")), "segments")


def _closest(met: DataFrame) -> DataFrame:
    """a, b and the closest fingerprints a_fp, b_fp of each pair of classes in t, t_class, t_more, p, p_class, p_more."""
    swap = F.col("t_class") > F.col("p_class")
    pair = F.struct(_apart().alias("apart"), F.when(swap, F.col("p")).otherwise(F.col("t")).alias("a_fp"), F.when(swap, F.col("t")).otherwise(F.col("p")).alias("b_fp"))
    return (met.select(F.least("t_class", "p_class").alias("a"), F.greatest("t_class", "p_class").alias("b"), pair.alias("pair"))
            .groupBy("a", "b").agg(F.min("pair").alias("pair")).select("a", "b", "pair.a_fp", "pair.b_fp"))


def _apart():
    return F.bit_count(F.col("t").bitwiseXOR(F.col("p"))) + F.bit_count(F.col("t_more").bitwiseXOR(F.col("p_more")))


def _star_pairs(table: DataFrame) -> DataFrame:
    """Candidate pairs of each class with the two ends (least and greatest fingerprint) of each of its buckets."""
    ends = (table.groupBy("seg", "value").agg(F.min(F.struct("fp", "class", "more")).alias("least"), F.max(F.struct("fp", "class", "more")).alias("most"))
            .where(F.col("least") != F.col("most")).select("seg", "value", F.explode(F.array("least", "most")).alias("end"))
            .select("seg", "value", F.col("end.fp").alias("p"), F.col("end.class").alias("p_class"), F.col("end.more").alias("p_more")))
    t = table.select("seg", "value", F.col("fp").alias("t"), F.col("class").alias("t_class"), F.col("more").alias("t_more"))
    return _closest(t.hint("merge").join(ends, ["seg", "value"]).where((F.col("t_class") != F.col("p_class")) & (_apart() <= WIDE_DISTANCE)))


def _wide_pairs(table: DataFrame) -> DataFrame:
    """Candidate pairs of classes, each with its closest fingerprints that met in a segment.

    One-bit neighbours have different parity, so only odd values look up their ball.
    """
    odd = F.bit_count("value") % 2 == 1
    ball = F.when(odd, F.array(*(F.lit(v) for v in (0, *(1 << i for i in range(SEGMENT_BITS)))))).otherwise(F.array(F.lit(0)))
    probes = table.withColumn("flip", F.explode(ball)).select("seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), (F.col("flip") == 0).alias("exact"),
                                                              F.col("fp").alias("p"), F.col("class").alias("p_class"), F.col("more").alias("p_more"))
    t = table.select("seg", "value", F.col("fp").alias("t"), F.col("class").alias("t_class"), F.col("more").alias("t_more"))
    # Equal values look each other up from both sides: one side is enough.
    once = F.when(F.col("exact"), F.col("t_class") < F.col("p_class")).otherwise(F.col("t_class") != F.col("p_class"))
    return _closest(t.hint("merge").join(probes, [t.seg == probes.seg, t.value == probes.value, once, _apart() <= WIDE_DISTANCE]))


def _similar(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose 5-word shingles agree."""
    asked = pairs.select(F.col("a_fp").alias("fp")).union(pairs.select(F.col("b_fp").alias("fp"))).distinct()
    sketches = written(prints.join(asked, "fp", "left_semi").groupBy("fp").agg(F.min("sketch").alias("sketch")), "sketches")
    sided = (pairs.join(sketches.select(F.col("fp").alias("a_fp"), F.col("sketch").alias("a_sketch")), "a_fp")
             .join(sketches.select(F.col("fp").alias("b_fp"), F.col("sketch").alias("b_sketch")), "b_fp").select("a", "b", "a_sketch", "b_sketch"))

    def rows(batch):
        for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= SIMILAR:
                yield a, b

    return sided.mapInArrow(arrow_rows(rows, pa.schema([("a", pa.int64()), ("b", pa.int64())])), "a long, b long")


def near_classes(prints: DataFrame) -> DataFrame:
    """fp and class of every fingerprint: near copies by fingerprint, joined where their shingles agree.

    1. Fingerprints within three bits are one class, as in ``near_duplicates``.
    2. Classes are looked up again by wider signatures: ``SEGMENTS`` further segments,
       within one bit of each; 128 bits, the fingerprint and those of the segments after
       it, may differ in ``WIDE_DISTANCE``.  A pair is a link when its 5-word shingles have a similarity of at least ``SIMILAR``.

    Before the whole look-up, classes meet only the two ends of their buckets: a large
    group of near copies becomes few classes by pairs linear in its size, and the look-up
    has one entry of each class in a bucket.  Texts of one bucket that are not similar
    (one common passage in each) still meet pair by pair.
    """
    distinct = written(prints.select("fp").distinct(), "distinct")
    close = distinct.join(components(near_pairs(distinct)), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("class"))
    classes = written(close, "classes")
    for candidates in (_star_pairs, _wide_pairs):
        pairs = written(candidates(_buckets(prints, classes)), "wide-pairs")
        joined = components(_similar(pairs, prints)).select(F.col("node").alias("class"), "component")
        classes = written(classes.join(joined, "class", "left").select("fp", F.coalesce("component", "class").alias("class")), "classes")
    return classes


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies (``near_classes``), with all columns.

    It is decided row by row: that of the smallest doc_id stays (rows without one come
    last), of several the one whose text has the smallest hash.  So texts that share a
    doc_id are judged apart, and of rows that repeat doc_id and text one stays.  Texts
    without words (null, empty) are near copies of each other; an empty table stays empty.
    """
    prints = written(_signatures(docs), "signatures")
    grouped = prints.select("no_id", "id", "key", "fp").distinct().join(near_classes(prints), "fp")
    first = grouped.groupBy("class").agg(F.min(F.struct("no_id", "id", "key")).alias("row")).select("row.*")
    no_id, i, key = _row_key()
    keyed = docs.select("*", no_id.alias("__no_id"), i.alias("__id"), key.alias("__key"))
    # Repeats of a row are cut to one in every task before they meet.
    again = Window.partitionBy("__no_id", "__id", "__key").orderBy(row_hash(docs))
    once = keyed.withColumn("__n", F.row_number().over(again)).where("__n = 1")
    stay = first.select(F.col("no_id").alias("__no_id"), F.col("id").alias("__id"), F.col("key").alias("__key"))
    return once.join(stay.hint("shuffle_hash"), ["__no_id", "__id", "__key"], "left_semi").select(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
