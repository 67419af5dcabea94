"""Document fingerprints by consistent weighted sampling (operator 9), DataFrame functions only.

The terms of a text are its words (A-Z lower-cased), weighted by how often they occur. For each of
``SAMPLES`` samples a term draws r and c from Gamma(2, 1) and b from the unit interval, all from hashes of
the term and the number of the sample; with weight s, t = floor(ln s / r + b) and
ln a = ln c - r (t + 1 - b). The term with the smallest a is the sample, (term, t) its value. Two texts
agree in a sample with the probability of their generalised Jaccard similarity, sum of min / sum of max.

A sample is one number: a's logarithm in the upper 40 bits, 23 bits of a hash of (term, t) below, so the
smallest number is the sample and its lower bits are the value. Words are counted and sampled where a
text's row lies after one shuffle of the texts.

Most terms can't be the smallest, and that is seen without a logarithm: with r = -ln w and c = -ln v a term of weight
s has a >= -w ln(v) / s, and -ln(v) is at least the first terms of its series. The smallest a of a text of n words is above ``BOUND`` / n with a probability of exp(-BOUND)
only, so terms whose least a lies above that are not drawn; where nothing below it is found, all terms are.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.llm.common import lower_az, stored

SAMPLES = 64  # a pair of similarity p is read with a standard deviation of sqrt(p (1 - p) / SAMPLES), at most 1/16
GROUP = 8  # samples computed per row
VALUE_BITS = 23
DIGITS = 6  # hexadecimal digits per sample
EMPTY = "f" * DIGITS  # sample of a text without words; a value has a smaller first digit
VALUE_STEP = 40_503
BOUND = 12.0  # a text with 64 samples and its second text are drawn in full with a probability of 128 exp(-12), 0.0008


def _draws(term: Column, number: Column, room: Column | None) -> tuple[Column, Column, Column]:
    """r, ln c and b of a term in the sample ``number``, from two hashes; r and ln c are null above ``room``.

    A Gamma(2, 1) variate is minus the logarithm of the product of two uniform ones, here two parts of a hash.
    """
    one = F.xxhash64(term, number)
    two = F.xxhash64(one)
    part = lambda h, at, bits: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5
    w = part(one, 32, 32) * part(one, 0, 32) * 2.0 ** -64
    v = part(two, 0, 21) * part(two, 21, 21) * 2.0 ** -42
    z = 1.0 - v
    least = z * (1.0 + z * (0.5 + z * (0.333 + z * 0.25))) * w  # of a times the weight: -ln(1 - z) >= z + z^2 / 2 + z^3 / 3 + ...
    near = (lambda x: x) if room is None else (lambda x: F.when(least <= room, x))
    return near(-F.ln(w)), near(F.ln(-F.ln(v))), part(two, 42, 22) * 2.0 ** -22


def _packed(log_a: Column) -> Column:
    return F.shiftleft(F.floor((log_a + 96.0) * 2.0 ** 33), VALUE_BITS)


def _sample(term: Column, log_weight: Column, r: Column, log_c: Column, b: Column) -> Column:
    """The packed sample of a term with a weight; null for a null weight."""
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t.cast("double") + 1.0 - b)
    value = term.bitwiseXOR(t * VALUE_STEP).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    return _packed(log_a).bitwiseOR(value)


def signatures(rows: DataFrame, key: list[str], samples: int = SAMPLES, texts: dict[str, str] | None = None,
               bound: float | None = None) -> DataFrame:
    """``*key`` and a fingerprint for every text of ``rows``; ``key`` is unique.

    ``texts`` maps text columns to the names of their fingerprints. The texts of a row share their draws, which
    don't depend on a weight: a term that several of them hold is drawn once. A text without words has a null, a
    row without words none. Rows that are partitioned by a part of ``key`` are not shuffled. With a ``bound``
    fewer terms are drawn, and ``sure`` tells whether a row's fingerprints are those without one.
    """
    texts = texts or {"text": "fingerprint"}
    names, kinds = list(texts.values()), range(len(texts))
    one_blank = lambda t: reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.col(t))
    blank = rows.select(*key, *[one_blank(t).alias(f"t{k}") for k, t in enumerate(texts)])
    counts = [F.coalesce(F.octet_length(f"t{k}") - F.octet_length(F.replace(f"t{k}", F.lit(" "), F.lit(""))), F.lit(0)) for k in kinds]
    share = F.lit(1) if bound is None else (F.least(*counts) if len(counts) > 1 else counts[0]) + 1  # about the words of the shorter text
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"t{k}").alias("text")) for k in kinds]))
    words = blank.select(*key, share.alias("share"), each.alias("x")).select(
        *key, "share", "x.kind", F.explode(F.split("x.text", " ")).alias("word")).where("word <> ''").withColumn(
        "word", F.when(F.octet_length("word") == F.length("word"), F.lower("word")).otherwise(lower_az(F.col("word"))))
    # Two counts to a long, which keeps what a task holds small.
    count = lambda k: F.when(F.col("kind") == k, F.lit(1 << 32 * (k % 2)).cast("long"))
    terms = words.select(*key, "share", "kind", F.xxhash64("word").alias("term")).groupBy(*key, "share", "term").agg(
        *[F.sum(F.coalesce(count(k), count(k + 1), F.lit(0).cast("long"))).alias(f"p{k // 2}") for k in kinds[::2]])
    terms = terms.select(*key, "share", "term", *[
        (F.shiftrightunsigned(f"p{k // 2}", 32) if k % 2 else F.col(f"p{k // 2}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"n{k}") for k in kinds])
    most = F.greatest(*[F.col(f"n{k}") for k in kinds]) if len(kinds) > 1 else F.col("n0")
    room = None if bound is None else F.col("room")
    terms = terms.select(
        *key, "share", "term", *[F.ln(F.nullif(f"n{k}", F.lit(0)).cast("double")).alias(f"w{k}") for k in kinds],
        *([] if bound is None else [(most * bound / F.col("share")).alias("room")]))
    groups = F.array(*[F.lit(g).cast("long") for g in range(samples // GROUP)])
    each_group = terms.select("*", F.explode(groups).alias("g"))
    drawn = each_group.select("*", *[
        c.alias(f"{n}{j}") for j in range(GROUP) for n, c in zip("rcb", _draws(F.col("term"), F.col("g") * GROUP + j, room))])
    least = drawn.groupBy(*key, "share", "g").agg(*[
        F.min(_sample(F.col("term"), F.col(f"w{k}"), *[F.col(f"{n}{j}") for n in "rcb"])).alias(f"s{k}_{j}")
        for k in kinds for j in range(GROUP)], *[F.max(f"w{k}").isNull().alias(f"none{k}") for k in kinds])
    # What was left out lies above this; one step of a sample less for rounding.
    limit = None if bound is None else _packed(F.ln(bound / F.col("share")) - 2.0 ** -32)
    sure = F.lit(True) if bound is None else reduce(and_, [
        F.col(f"none{k}") | F.coalesce(F.greatest(*[F.coalesce(f"s{k}_{j}", limit) for j in range(GROUP)]) < limit, F.lit(False)) for k in kinds])
    digits = lambda k: F.concat(*[F.lpad(F.lower(F.hex(
        F.col(f"s{k}_{j}").bitwiseAND(F.lit((1 << VALUE_BITS) - 1)))), DIGITS, "0") for j in range(GROUP)])
    listed = least.select(*key, F.struct("g", *[digits(k).alias(f"d{k}") for k in kinds], sure.alias("sure")).alias("part")).groupBy(*key).agg(
        F.sort_array(F.collect_list("part")).alias("parts"))
    return listed.select(*key, *[
        F.when(F.col("parts")[0][f"d{k}"].isNotNull(), F.array_join(F.col(f"parts.d{k}"), "")).alias(n) for k, n in enumerate(names)],
        *([] if bound is None else [F.array_min("parts.sure").alias("sure")]))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree."""
    def part(signature: Column, i: Column) -> Column:
        return signature.substr(i * DIGITS + 1, F.lit(DIGITS))

    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: part(a, i) == part(b, i))
    return F.when(a.isNotNull() & b.isNotNull(), F.size(same) / F.lit(float(samples)))


KEY = ["no_id", "id", "mark"]
KEPT = "left(text, cast(n - n div 2 as int))"  # of an edited text


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64(text, F.length(text)).alias("mark"), text.alias("text"))


def _ring(docs: DataFrame) -> DataFrame:
    """One row per different document with ``n`` code points, its ``copies``, and the one before and after it.

    Order: null ids, ids, then a hash of the text; the last is followed by the first. Ranges of the order are
    dealt out, neighbours are found inside each, and the borders from one row per range.
    """
    light = _keyed(docs).groupBy(*KEY).agg(F.count("*").alias("copies"), F.max(F.length("text").cast("long")).alias("n"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("no_id").desc(), F.col("id"), F.col("mark")]
    dealt, _ = stored(
        light.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ring")
    place = F.struct((~F.col("no_id")).alias("has_id"), "id", "mark", "n")
    ends = dealt.groupBy("range").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    line = Window.orderBy("range")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "range", F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("prior"),
        F.coalesce(F.lead("first").over(line), F.first("first").over(whole)).alias("next"))
    inside = Window.partitionBy("range").orderBy(*order)
    near = dealt.withColumn("own", place).withColumn("before", F.lag("own").over(inside)).withColumn("after", F.lead("own").over(inside))
    return near.join(ends, "range").select(
        *KEY, "copies", "n", F.coalesce("before", "prior").alias("before"), F.coalesce("after", "next").alias("after"))


def _edited(docs: DataFrame, ring: DataFrame) -> DataFrame:
    """``*KEY, text, edited`` of the different documents."""
    texts = _keyed(docs).dropDuplicates(KEY).join(
        ring.select(*KEY, "n", (~F.col("before.has_id")).alias("to_no_id"), F.col("before.id").alias("to_id"),
                    F.col("before.mark").alias("to_mark"), F.expr("before.n div 2").alias("wanted")), KEY)
    heads = texts.select(
        F.col("to_no_id").alias("no_id"), F.col("to_id").alias("id"), F.col("to_mark").alias("mark"),
        F.expr("left(text, cast(wanted as int))").alias("head"))
    return texts.join(heads, KEY).select(*KEY, "text", F.concat(F.expr(KEPT), "head").alias("edited"))


def _edited_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """``_edited`` of the documents in ``few``, rows of the ring; texts of others don't move while ``few`` is broadcast."""
    texts = _keyed(docs)
    own = texts.join(few.select(*KEY, "n"), KEY).dropDuplicates(KEY)
    wanted = few.select(
        F.struct(*KEY).alias("of"), (~F.col("after.has_id")).alias("no_id"), F.col("after.id").alias("id"),
        F.col("after.mark").alias("mark"), F.expr("n div 2").alias("wanted"))
    heads = texts.join(wanted, KEY).select("of.*", F.expr("left(text, cast(wanted as int))").alias("head")).dropDuplicates(KEY)
    return own.join(heads, KEY).select(*KEY, "text", F.concat(F.expr(KEPT), "head").alias("edited"))


def _signed(docs: DataFrame, ring: DataFrame, bound: float = BOUND) -> DataFrame:
    """``ring`` with the fingerprints of its documents, as bytes, and the hash of their edited texts, stored."""
    pairs = _edited(docs, ring)
    names = {"text": "fingerprint", "edited": "edited_fingerprint"}
    none = F.lit(EMPTY * SAMPLES)
    filled = lambda df: df.withColumns({c: F.unhex(F.coalesce(c, none)) for c in names.values()})
    hashed = pairs.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    known = filled(ring.join(signatures(pairs, KEY, texts=names, bound=bound), KEY, "left").join(hashed, KEY))
    known, _ = stored(known.withColumn("sure", F.coalesce("sure", F.lit(True))), "fingerprints")
    few, _ = stored(known.where(~F.col("sure")).drop(*names.values()), "unsure")
    if few.isEmpty():
        return known.drop("sure")
    again, _ = stored(signatures(_edited_of(docs, few), KEY, texts=names), "again")
    return known.where("sure").unionByName(filled(few.join(again, KEY, "left"))).drop("sure")


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``.

    A null text is an empty one. Rows equal in id and text are one document in the order and share its
    results; rows of one id with different texts follow each other by a hash of the text; a null id comes
    first. A document alone is its own next. Two texts without words are alike (1), one with and one
    without are not (0). An empty table gives an empty table.
    """
    ring, _ = stored(_ring(docs), "ring")
    known = _signed(docs, ring)  # bytes are half of what the join would move as digits
    next_one = known.select(
        (~F.col("before.has_id")).alias("no_id"), F.col("before.id").alias("id"), F.col("before.mark").alias("mark"),
        F.col("fingerprint").alias("next_fingerprint"))
    digits = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint", "next_fingerprint")}
    return known.join(next_one, KEY).withColumns(digits).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
