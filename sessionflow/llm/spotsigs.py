"""Document fingerprints: SpotSigs, with DataFrame functions only.

An anchor followed by the next ``CHAIN`` content words, common words between
them left out, is one spot signature. Anchors are the common words, the start
of the text, and one in ``SPACING`` content words, picked by hash: where common
words are rare (tables, code, other languages) the picked words carry the
chains, and an edit changes only signatures near it, whatever stands around.
A text with no anchor but its start has a chain after every word; one too
short for a chain is one signature as a whole. A text's fingerprint is the set
of its signatures, each as a 32-bit hash. Likeness of two fingerprints is the
Jaccard similarity of the sets. All steps take time in proportion to the text.

:func:`similar` joins a whole table with itself: sets are partitioned by
length, a pair meets only if their lengths allow the threshold and they share
one of the rare signatures that a pair above it must share, and the exact
similarity is computed last.

Semantics: a null or empty text has the empty fingerprint; two empty
fingerprints are alike (1.0), an empty and another one are not (0.0). Equal
texts have equal fingerprints. Words are runs of letters and digits in lower
case. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, salted_join, staged

#: Content words of one signature.
CHAIN = 2
#: One in so many content words is an anchor, by its CRC-32.
SPACING = 4
#: Ids with more than this share of the rows, fewer than its inverse, are dealt
#: out over tasks of about ``DEALT_ROWS`` rows.
HOT_SHARE = 1e-4
DEALT_ROWS = 2_000
# Common words of the languages of the corpus.
ANCHORS = (
    "the of and to a in is that it for as was with be by on are this from or an at not "
    "der die das und ist ein eine zu den von mit dem des im nicht sich auf für "
    "le la les de du des et un une est que en dans pour au aux sur par avec pas qui ce "
    "el los las y del una con por para se no al lo como su"
).split()
_MARK = "\u0001"


def _picked(word: Column) -> Column:
    """Whether a content word is an anchor (the start's empty name is not)."""
    return (word != "") & (F.crc32(word) % SPACING == 0)


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sorted distinct signature hashes (array<int>) of ``text``.

    Built in steps, so that a part used twice is computed once. What a lambda
    needs of several arrays is zipped before: a column of another step inside
    a lambda would be computed per element.
    """
    common = sorted(set(ANCHORS))
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.transform("_words", lambda w: F.when(w.isin(common), F.concat(F.lit(_MARK), w)).otherwise(w))
    line = F.concat(F.array_join(marked, " "), F.lit(" "))
    # the common words before every content word, and behind the last
    runs = F.split("_line", rf"(?<![^ ])[^{_MARK} ][^ ]* ")
    n = F.greatest(F.size("_content") - (CHAIN - 1), F.lit(0))
    before = F.concat(F.array(F.lit("")), F.col("_content"))
    chain = [F.slice("_content", i + 1, n).alias(f"w{i}") for i in range(CHAIN)]
    spots = F.arrays_zip(F.slice("_runs", 1, n).alias("run"), F.slice(before, 1, n).alias("before"), *chain)

    def signature(name: Column, spot: Column) -> Column:
        return F.hash(name, *[spot[f"w{i}"] for i in range(CHAIN)])

    def of_spot(spot: Column) -> Column:
        run, name = spot["run"], spot["before"]
        own = F.when((name == "") | _picked(name), F.array(signature(name, spot))).otherwise(F.array().cast("array<int>"))
        named = F.filter(F.array_distinct(F.split(run, " ")), lambda w: w != "")
        return F.when(run == "", own).otherwise(F.concat(own, F.transform(named, lambda w: signature(w, spot))))

    anchored = F.exists("_spots", lambda spot: (spot["run"] != "") | _picked(spot["before"]))
    after_anchors = F.flatten(F.transform("_spots", of_spot))
    after_every_word = F.transform("_spots", lambda spot: signature(spot["before"], spot))
    whole = F.when(F.size("_words") > 0, F.array(F.hash(F.array_join("_words", " "))))
    found = (
        F.when(F.size("_spots") == 0, F.coalesce(whole, F.array().cast("array<int>")))
        .when(F.col("_anchored"), after_anchors)
        .otherwise(after_every_word)
    )
    return (
        df.withColumn("_words", words)
        .withColumn("_line", line)
        .withColumn("_runs", runs)
        .withColumn("_content", F.filter("_words", lambda w: ~w.isin(common)))
        .withColumn("_spots", spots)
        .withColumn("_anchored", anchored)
        .withColumn(out, F.array_sort(F.array_distinct(found)))
        .drop("_words", "_line", "_runs", "_content", "_spots", "_anchored")
    )


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: 8 hex digits per signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1.0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def next_ids(ids: DataFrame, parts: int = 64) -> DataFrame:
    """(doc_id, next_id, prev_id) over distinct ids, descending and closed to a ring.

    Ids are dealt by ranges into ``parts`` partitions, neighbours are found
    inside each, and a table of one row per partition closes the gaps. Only
    ids move.
    """
    ranged = staged(
        ids.distinct().repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    ends = ranged.groupBy("part").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    ring = Window.orderBy("part")  # one row per partition, ``parts`` at most
    edge = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lag("high").over(ring), F.last("high").over(edge)).alias("below"),
        F.coalesce(F.lead("low").over(ring), F.first("low").over(edge)).alias("above"),
    )
    near = Window.partitionBy("part").orderBy("doc_id")
    return (
        ranged.withColumn("_next", F.lag("doc_id").over(near))
        .withColumn("_prev", F.lead("doc_id").over(near))
        .join(F.broadcast(ends), "part")
        .select(
            "doc_id",
            F.coalesce("_next", "below").alias("next_id"),
            F.coalesce("_prev", "above").alias("prev_id"),
        )
    )


def _hot_ids(per_id: DataFrame) -> DataFrame:
    """(doc_id, shares) of the ids that hold more than ``HOT_SHARE`` of the rows."""
    total = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]
    shares = F.ceil(F.col("n") / DEALT_ROWS).cast("int").alias("shares")
    return per_id.where(F.col("n") > max(total * HOT_SHARE, DEALT_ROWS)).select("doc_id", shares)


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with ``_share``: the rows of a hot id are dealt out in turn, others are share 0.

    Any share gives the same join, as the other side is there for all of them;
    equal rows are dealt out too. ``hot`` has at most 1 / ``HOT_SHARE`` rows.
    """
    dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce("shares", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot), "doc_id", "left").withColumn("_share", dealt).drop("shares")


def _for_all_shares(lookup: DataFrame, hot: DataFrame) -> DataFrame:
    """``lookup``, one row per id, repeated for every share of a hot id."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))
    return lookup.join(F.broadcast(hot), "doc_id", "left").withColumn("_share", every).drop("shares")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text ends with the beginning of the next document, descending
    id (after the last: the first), in place of the last third. Rows without
    id follow the least id; of rows that repeat an id, the least text is the
    one that its predecessors see, and each is edited by itself.
    """
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = staged(next_ids(base.select("doc_id")), "order")
    # how much of a document its predecessors may need
    per_id = staged(
        base.groupBy("doc_id").agg(
            F.max(F.floor(F.length("text") / 3)).cast("int").alias("third"), F.count(F.lit(1)).alias("n")
        ),
        "per-id",
    )
    hot = _hot_ids(per_id)
    wanted = order.join(per_id.select("doc_id", "third"), "doc_id").select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), F.col("third")
    )
    own = with_signatures(_dealt(base, hot), "text", "sigs")
    # the shares of the asking id come before the aggregate: its exchange then serves the join
    lent = _for_all_shares(
        own.join(_for_all_shares(wanted, hot), ["doc_id", "_share"]).select(
            F.col("to_id").alias("doc_id"),
            F.expr("left(text, third)").alias("head"),
            F.col("sigs").alias("next_sigs"),
        ),
        hot,
    )
    lent = lent.groupBy("doc_id", "_share").agg(F.min(F.struct("head", "next_sigs")).alias("next"))
    both = own.join(lent, ["doc_id", "_share"])
    both = both.withColumn("cut", F.floor(F.length("text") / 3).cast("int"))
    edited = both.withColumn(
        "edited", F.expr("concat(left(text, length(text) - cut), left(next.head, cut))")
    )
    edited = with_signatures(edited, "edited", "edited_sigs")
    return edited.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next.next_sigs")).alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Texts with likeness of at least ``threshold`` in a whole table.

    Returns (members, pairs): ``members`` has one row (doc_id, class_id) per
    document, where a class holds equal fingerprints and is named by its least
    id; ``pairs`` has (class_a, class_b, likeness) per pair of classes, a < b.

    Sets whose likeness reaches t have lengths within a factor t of each
    other and share one of their n - ceil(t n) + 1 rarest signatures. Lengths
    are cut into bands a factor 1/t wide, so a set meets its own band and the
    next one only.
    """
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = with_signatures(base, "text", "sigs").select(
        "doc_id", "sigs", F.sha2(as_text(F.col("sigs")), 256).alias("key")
    )
    rows = staged(rows, "spots")
    classes = staged(
        rows.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs")),
        "spot-classes",
    )
    members = salted_join(rows.select("doc_id", "key"), classes.select("key", "class_id"), ["key"], ["doc_id"])
    sets = classes.where("size(sigs) > 0").select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    seen = sets.groupBy("sig").agg(F.count(F.lit(1)).alias("seen"))
    rare = Window.partitionBy("class_id").orderBy("seen", "sig")
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")
    prefix = (
        salted_join(sets, seen, ["sig"], ["class_id"])
        .withColumn("place", F.row_number().over(rare))
        .where(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
        .select("class_id", "n", "sig", band.alias("band"))
    )
    prefix = staged(prefix, "spot-prefixes")
    a = prefix.select(F.col("class_id").alias("class_a"), F.col("n").alias("n_a"), "sig", "band")
    b = prefix.select(
        F.col("class_id").alias("class_b"), F.col("n").alias("n_b"), "sig",
        F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"),
    )
    fits = (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    met = (
        a.join(b, ["sig", "band"])
        .where(fits & (F.col("class_a") != F.col("class_b")))
        .select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
        .distinct()
    )
    left = classes.select(F.col("class_id").alias("class_a"), F.col("sigs").alias("sigs_a"))
    right = classes.select(F.col("class_id").alias("class_b"), F.col("sigs").alias("sigs_b"))
    pairs = (
        met.join(left, "class_a").join(right, "class_b")
        .select("class_a", "class_b", likeness(F.col("sigs_a"), F.col("sigs_b")).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
    return members.select("doc_id", "class_id"), pairs
