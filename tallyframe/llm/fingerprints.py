"""Document fingerprints: SimHash and the search for fingerprints within a Hamming radius. DataFrame functions only.

Every term (a run of words) of a text has a 64-bit hash and votes for or against each bit with the weight of its
occurrences. A sum of 64 bits holds the votes of two fingerprint bits, 32 places each, so 32 sums count them all.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.workspace import settle

#: Words of a term.
TERM_WORDS = 5
#: Documents of one piece of the order by id, about.
PIECE = 500
#: Pieces at most: their borders pass through the driver. More documents make larger pieces.
MOST_PIECES = 20_000
#: Bits in which the fingerprints of near documents differ at most.
RADIUS = 3
#: Blocks that a fingerprint is cut into for the search, beside the radius.
MORE_BLOCKS = 3

_SPACE = r"[\x20\x09-\x0D]+"


def _terms(text: Column, n: int) -> Column:
    """Hashes of the runs of n words of a text, lower-cased; fewer words are one term; no word, no term."""
    words = F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
        return F.when(F.size(h) > 0, F.transform(starts, lambda at: F.xxhash64(*[F.get(h, at + k) for k in range(n)])))

    # as the variable of a function the hashes are computed once, and not for every run
    return F.get(F.transform(F.array(hashed), runs), 0)


def simhash(rows: DataFrame, keys: list[str], text: str, name: str, term_words: int = TERM_WORDS) -> DataFrame:
    """``keys`` and the fingerprint ``name`` (long) of ``text``, one row per distinct combination of the keys.

    A term weighs as much as it occurs. The bits with more weight for than against them are set; ties, and a text
    without a word, leave bits unset. Terms are counted in the task that makes them: what moves is 33 numbers a row.
    """
    exploded = rows.select(*keys, F.explode_outer(_terms(F.col(text), term_words)).alias("_term"))
    # bit b of a term is counted in the low half of sum b, bit b + 32 in its high half
    both = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("_term", b).bitwiseAND(both)).alias(f"_s{b}") for b in range(32)]
    counted = exploded.groupBy(*keys).agg(F.count("_term").alias("_n"), *sums)
    bits = []
    for b in range(32):
        low, high = F.col(f"_s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{b}", 32)
        for votes, place in ((low, b), (high, b + 32)):
            bits.append(F.when(2 * votes > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits of two fingerprints."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hexadecimal(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _piece(ident: Column, borders: list[int]) -> Column:
    """How many of the sorted borders lie below ``ident``: first among every w-th border, then among w."""
    width = max(1, int(len(borders) ** 0.5))
    groups = [borders[at : at + width] for at in range(0, len(borders), width)]
    if not groups:
        return F.lit(0)
    group = F.size(F.filter(F.lit([g[-1] for g in groups]), lambda b: b < ident))
    inner = F.coalesce(F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), group), lambda b: b < ident)), F.lit(0))
    return group * width + F.when(group < len(groups), inner).otherwise(0)


def in_order(docs: DataFrame) -> DataFrame:
    """piece, pos, ghost, doc_id, text, next_text: documents by descending id with the next one's text.

    After the last document comes the first. Null texts are empty; null ids come last, by a hash of the text; equal
    ids go by text. The order is cut into pieces of about PIECE documents, at quantiles of the id and in ranges of the
    hash. The first document of each piece is also dealt, as a ghost, to the piece before it, and that of the first
    piece to the last one; so each piece finds the next documents on its own, and texts move once.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n, with_id = rows.agg(F.count("*"), F.count("doc_id")).first()
    pieces, spread = (max(1, min(MOST_PIECES, m // PIECE)) for m in (with_id, n - with_id))
    borders: list[int] = []
    if pieces > 1:
        shares = F.lit([p / pieces for p in range(1, pieces)])
        found = rows.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * pieces)))).first()[0]
        borders = sorted(set(found))
    hashed = F.xxhash64("text")
    with_ids = F.lit(len(borders)) - _piece(F.col("doc_id"), borders)
    without = F.lit(len(borders) + 1) + F.floor((F.lit(0.5) - hashed / 2.0**64) * spread).cast("int")
    rows = rows.withColumn("piece", F.when(F.col("doc_id").isNotNull(), with_ids).otherwise(without).cast("int"))
    rows = rows.withColumn("key", F.coalesce("doc_id", hashed))

    # at most twice MOST_PIECES rows
    first = sorted(tuple(r) for r in rows.groupBy("piece").agg(F.max("key")).collect())
    before = [(piece, key, first[at - 1][0]) for at, (piece, key) in enumerate(first)]
    firsts = docs.sparkSession.createDataFrame(before, "piece int, key long, before int")
    ghosts = (
        rows.join(F.broadcast(firsts), ["piece", "key"])
        .groupBy("before")
        .agg(F.max("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("piece"))
        .withColumn("key", F.lit(None).cast("long"))
        .withColumn("ghost", F.lit(True))
    )
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    order = Window.partitionBy("piece").orderBy("ghost", F.desc("key"), F.desc("text"))
    return both.select(
        "piece", F.row_number().over(order).alias("pos"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


def fingerprints(docs: DataFrame, term_words: int = TERM_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of a document's characters replaced by as many of the first of the next
    document (see :func:`in_order`). Fingerprints are 16 hexadecimal digits, likenesses shares of equal bits. A null
    or empty text has fingerprint 0 and is edited to itself; of a single document the next is itself. Rows that
    repeat stay; other columns are not looked at; an empty table gives an empty result.
    """
    rows = in_order(docs)
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    edited = F.when(~F.col("ghost"), edited)
    rows = rows.select("piece", "pos", "ghost", "doc_id", n.alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["piece", "pos", "ghost", "doc_id", "n_chars", "edited_sha256"]
    kinds = [F.struct(F.lit(n).alias("which"), F.col(t).alias("_text")) for n, t in enumerate(("text", "edited"))]
    each = rows.select(*keys, F.inline(F.array(*kinds))).filter("_text is not null")
    # all that follows groups and orders within pieces, as the rows already are
    marked = simhash(each, [*keys, "which"], "_text", "fp", term_words)
    pair = marked.groupBy(*keys).agg(
        F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp")
    )
    following = F.lead("fp").over(Window.partitionBy("piece").orderBy("pos"))
    return (
        pair.withColumn("next_fp", following)
        .filter(~F.col("ghost"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            hexadecimal(F.col("fp")).alias("fingerprint"),
            hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        )
    )


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS, more_blocks: int = MORE_BLOCKS) -> DataFrame:
    """All pairs (query, found, distance) of distinct fingerprints at most ``radius`` bits apart; columns fp, longs.

    Fingerprints are cut into radius + more_blocks blocks. Two that differ in at most radius bits are equal in
    more_blocks blocks at least, so there is a table for each choice of so many blocks, keyed by their bits, and a pair
    meets in one table or more. Distinct fingerprints alone meet: equal ones are one row. Nulls match nothing.
    """
    blocks = radius + more_blocks
    cuts = [64 * b // blocks for b in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    signed = [m - (1 << 64) if m >> 63 else m for m in (sum(chosen) for chosen in combinations(masks, more_blocks))]

    def tables(fps: DataFrame, name: str) -> DataFrame:
        one = fps.select(F.col("fp").alias(name)).filter(F.col(name).isNotNull()).distinct()
        keyed = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(signed)])
        return one.select(name, F.inline(keyed))

    differ = F.col("query").bitwiseXOR(F.col("found"))
    met = tables(queries, "query").join(tables(fingerprints, "found"), ["t", "k"]).withColumn("distance", F.bit_count(differ))
    # a pair counts in the first of the tables where it meets
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(signed)])
    return met.filter(F.col("distance") <= radius).filter(F.col("t") == first).select("query", "found", "distance")


def with_near(docs: DataFrame, radius: int = RADIUS, term_words: int = TERM_WORDS) -> DataFrame:
    """:func:`fingerprints` of ``docs`` with near_documents, nearest_distance, nearest_id.

    Near are all other rows whose fingerprint is at most ``radius`` bits apart; nearest_id is the smallest id at the
    least distance, and with equal fingerprints the smallest of them, or the largest for a row that has the smallest
    itself. Null if there is none. Every row is asked for; distinct fingerprints alone meet.
    """
    rows = fingerprints(docs, term_words).withColumn("fp", F.conv("fingerprint", 16, -10).cast("long"))
    rows = settle(rows, "fingerprints")
    classes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    classes = settle(classes, "classes")
    pairs = within_radius(classes, classes, radius).filter("distance > 0")
    found = pairs.join(classes.select(F.col("fp").alias("found"), "n", "least"), "found").groupBy("query")
    # ids that are null come last
    nearest = F.min(F.struct("distance", F.col("least").isNull().alias("no"), "least")).alias("nearest")
    found = found.agg(F.sum("n").alias("others"), nearest).withColumnRenamed("query", "fp")
    near = settle(classes.join(found, "fp", "left"), "near")
    same = F.col("n") > 1
    other = F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.col("most")).otherwise(F.col("least"))
    names = [c for c in rows.columns if c != "fp"]
    return rows.join(near, "fp").select(
        *names,
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("near_documents"),
        F.when(same, 0).otherwise(F.col("nearest.distance")).cast("int").alias("nearest_distance"),
        F.when(same, other).otherwise(F.col("nearest.least")).alias("nearest_id"),
    )
